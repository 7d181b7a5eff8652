"""One place for options: storage backends and the values that alter results."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

from pyspark.sql import SparkSession

#: Storage backends: whether buckets are part of the path (fixed values).
BACKENDS = {"aws": False, "cloudflare": False, "minio": True, "google_s3": True}
ROLES = ("main", "train", "eval", "test", "model")


def r2_endpoint(account: str) -> str:
    if not account or not account.strip():
        raise ValueError("The account is empty")
    return f"https://{account.strip()}.r2.cloudflarestorage.com"


def _flag(text: str) -> bool:
    return text.strip().lower() in ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Storage:
    backend: str = "aws"
    endpoint: str | None = None
    access_key: str | None = None
    secret_key: str | None = None
    region: str | None = None
    session_token: str | None = None
    buckets: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.backend not in BACKENDS:
            raise ValueError(f"Unknown storage backend: {self.backend}; known: {', '.join(sorted(BACKENDS))}")
        if BACKENDS[self.backend] and not self.endpoint:
            raise ValueError(f"{self.backend} needs an endpoint")
        if self.endpoint and self.endpoint.rstrip("/").endswith(":9001"):
            raise ValueError("Port 9001 is a console's; the object interface is mostly at 9000")

    @classmethod
    def one_bucket(cls, bucket: str, **options) -> Storage:
        if not bucket or not bucket.strip():
            raise ValueError("The bucket is empty")
        return cls(buckets=dict.fromkeys(ROLES, bucket.strip()), **options)

    def root(self, role: str) -> str:
        if not self.buckets.get(role):
            raise ValueError(f"No bucket for {role}")
        return f"s3a://{self.buckets[role]}"

    def hadoop_options(self) -> dict[str, str]:
        found = {"endpoint": self.endpoint, "access.key": self.access_key, "secret.key": self.secret_key, "endpoint.region": self.region, "session.token": self.session_token}
        out = {f"spark.hadoop.fs.s3a.{k}": v for k, v in found.items() if v}
        return out | {"spark.hadoop.fs.s3a.path.style.access": str(BACKENDS[self.backend]).lower()}

    def apply(self, builder: SparkSession.Builder) -> SparkSession.Builder:
        return builder.config(map=self.hadoop_options())


@dataclass(frozen=True)
class Settings:
    """Defaults of windows, training and gates; from_env reads names in capitals."""

    sequence_stride: int = 100
    test_stride: int = 1000
    batch_size: int = 64
    shuffle_train_data: bool = True
    learning_rate: float = 1e-3
    epochs: int = 50
    eval_min_precision: float = 0.55
    eval_min_recall: float = 0.4
    max_overfit_gap: float = 0.2
    min_signals: int = 400
    min_sequences: int = 1000
    max_imbalance_ratio: float = 4.0
    tree_trials: int = 30
    net_trials: int = 20
    exclude_class_id: int = -1

    @classmethod
    def from_env(cls, env=os.environ) -> Settings:
        read = {"int": int, "float": float, "bool": _flag}
        return cls(**{f.name: read[f.type](env[f.name.upper()]) for f in fields(cls) if f.name.upper() in env})
