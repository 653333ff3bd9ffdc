"""Run parameters, and the places in shared storage that jobs may write to."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from rangeloom.functions.scalar import env_truth


@dataclass(frozen=True)
class RunConfig:
    """The knobs of a capture run that have a meaning for Spark.

    Field defaults are the production defaults. ``from_env`` reads upper-case names with the given prefix;
    booleans follow ``env_truth``: set, not empty and not "0".
    """

    filename_size: int = 8
    filedata_size: int = 40
    extra_bytes: int = 0
    particles_per_rank: int = 0
    max_record_bytes: int = 255
    epoch_max_writes: int = 0
    skip_sampling: bool = False
    sample_threshold: int = 100
    key_offset: int = 0
    key_size: int = 4
    layout: str = "inline"
    receiver_radix: int = 0
    oob_capacity: int = 512
    pivots_per_stage: tuple[int, int, int] = (256, 256, 256)
    reneg_policy: str = "intra_epoch"
    reneg_interval: int = 500_000
    ignore_dirs: tuple[str, ...] = ()
    bypass_shuffle: bool = False
    bypass_write: bool = False
    extra: Mapping[str, str] = field(default_factory=dict)

    LAYOUTS = ("inline", "kvsep", "filter", "range")
    POLICIES = ("intra_epoch", "inter_epoch")

    def __post_init__(self) -> None:
        if self.layout not in self.LAYOUTS:
            raise ValueError(f"layout must be one of {self.LAYOUTS}")
        if self.reneg_policy not in self.POLICIES:
            raise ValueError(f"reneg_policy must be one of {self.POLICIES}")
        if self.key_size != 4:
            raise ValueError("keys are 4-byte floats")
        if not 0 <= self.receiver_radix <= 8:
            raise ValueError("receiver_radix must be within 0 and 8")
        if max(self.pivots_per_stage) > 8192:
            raise ValueError("at most 8192 pivots a stage")
        if self.record_bytes > self.max_record_bytes:
            raise ValueError("a record does not fit the record buffer")

    @property
    def record_bytes(self) -> int:
        return self.filename_size + self.filedata_size + self.extra_bytes

    @classmethod
    def from_env(cls, prefix: str = "RANGELOOM_", env: Mapping[str, str] | None = None) -> RunConfig:
        env = os.environ if env is None else env
        given = {k[len(prefix) :].lower(): v for k, v in env.items() if k.startswith(prefix)}
        args: dict = {}
        for name, spec in cls.__dataclass_fields__.items():
            if name not in given or name == "extra":
                continue
            default, text = spec.default, given.pop(name)
            if isinstance(default, bool):
                args[name] = env_truth(text)
            elif isinstance(default, int):
                args[name] = int(text)
            elif name == "pivots_per_stage":
                args[name] = tuple(int(x) for x in text.split(","))
            elif isinstance(default, tuple):
                args[name] = tuple(x for x in text.split(":") if x)
            else:
                args[name] = text
        return cls(**args, extra=given)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a folder of our own in local mode.

    The session's setting always wins. Only where it is unset (tests, a laptop) is a temporary folder taken.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        given = tempfile.mkdtemp(prefix="rangeloom-")
        spark.sparkContext.setCheckpointDir(given)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(given)
    return given


def clean(spark: SparkSession) -> None:
    """Remove the tables that this library wrote to the shared folder; no result that reads them may be in use."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/rangeloom")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for a table of our own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/rangeloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, partition_by: Iterable[str] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, "table")
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


class SharedFiles:
    """Small files below a folder of any file system that Spark reaches; paths without a scheme are in the default one."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self._root = spark._jvm, root.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self._root}/{name}" if name else self._root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, folder: str) -> list[str]:
        """The names of what is in a folder; none where it does not exist."""
        return [f.getPath().getName() for f in self._fs.listStatus(self._at(folder))] if self.exists(folder) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write a file as a whole: under another name first, so that a reader never sees a part of it."""
        part = self._at(f"{name}.part")
        stream = self._fs.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._fs.delete(self._at(name), False)
        if not self._fs.rename(part, self._at(name)):
            raise OSError(f"cannot write {name}")
