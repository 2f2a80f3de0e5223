"""Job settings: a typed record, read from `key: value` lines."""

from __future__ import annotations

from dataclasses import dataclass, fields

MODELS = ("LogisticRegression", "CollaborativeFiltering", "Softmax")
OPTIMIZERS = ("sgd", "adagrad", "momentum", "nesterov")


@dataclass(frozen=True)
class JobConfig:
    """Settings of one training job. Ranges of chunks are half open."""

    load_input_path: str = ""
    dataset_format: str = "csv"
    model_type: str = "LogisticRegression"
    opt_method: str = "adagrad"
    learning_rate: float = 0.01
    epsilon: float = 1e-4
    momentum_beta: float = 0.9
    minibatch_size: int = 20
    s3_size: int = 50_000
    model_bits: int = 20
    limit_samples: int = 0
    limit_cols: int = 0
    num_users: int = 0
    num_items: int = 0
    num_factors: int = 10
    normalize: bool = False
    use_bias: bool = True
    use_grad_threshold: bool = False
    grad_threshold: float = 0.0
    train_set: tuple[int, int] = (0, 0)
    test_set: tuple[int, int] = (0, 0)

    def __post_init__(self):
        if self.model_type not in MODELS:
            raise ValueError(f"model_type is one of {MODELS}, not {self.model_type!r}")
        if self.opt_method not in OPTIMIZERS:
            raise ValueError(f"opt_method is one of {OPTIMIZERS}, not {self.opt_method!r}")
        if self.minibatch_size <= 0 or self.s3_size <= 0 or not 0 < self.model_bits <= 30:
            raise ValueError("minibatch_size and s3_size are positive, model_bits is in 1..30")
        for low, high in (self.train_set, self.test_set):
            if low < 0 or high < low:
                raise ValueError(f"not a range: {low}-{high}")
        (a, b), (c, d) = self.train_set, self.test_set
        if max(a, c) < min(b, d):
            raise ValueError("train_set and test_set overlap")


def parse(text: str) -> JobConfig:
    """A config from lines `key: value`; `#` begins a comment; unknown keys are
    errors. Ranges are written `0-824`, flags as 0 or 1."""
    kinds = {f.name: f.type for f in fields(JobConfig)}
    found = {}
    for number, line in enumerate(text.splitlines(), 1):
        line = line.split("#", 1)[0].strip()
        if not line:
            continue
        key, colon, value = (x.strip() for x in line.partition(":"))
        if not colon or key not in kinds:
            raise ValueError(f"line {number}: no setting {key!r}")
        kind = kinds[key]
        if kind.startswith("tuple"):
            low, dash, high = value.partition("-")
            if not dash:
                raise ValueError(f"line {number}: a range is written low-high")
            found[key] = (int(low), int(high))
        else:
            found[key] = {"str": str, "int": int, "float": float, "bool": lambda v: v.lower() in ("1", "true")}[kind](value)
    return JobConfig(**found)


def render(config: JobConfig) -> str:
    """The text that parse() reads back."""
    show = lambda v: f"{v[0]}-{v[1]}" if isinstance(v, tuple) else str(int(v)) if isinstance(v, bool) else str(v)
    return "".join(f"{f.name}: {show(getattr(config, f.name))}\n" for f in fields(config))
