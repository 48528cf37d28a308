"""Session construction, the shared checkpoint folder and small planning helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes (of the rows as text) up to which a dimension table is broadcast; beyond them the join is left to Catalyst (shuffle plus AQE skew handling).
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 << 20


def build_session(master: str = "local[*]", app: str = "tidewheel", **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; ``conf`` overrides or adds settings."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    } | conf
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one named in ``spark.checkpoint.dir``, else one already set, else (local tests) a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not sc.master.startswith("local"):  # "local" masters are one machine
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidewheel-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_tidewheel_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tidewheel-code-")) / "tidewheel.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._tidewheel_shipped = True


def checkpoint(df: DataFrame, keep_partitioning: bool = False) -> DataFrame:
    """``df`` written reliably to the shared folder, with its lineage cut.

    ``keep_partitioning``: later plans know how the rows are partitioned and ordered. An adaptive plan forgets it, so this one is planned without.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if not keep_partitioning:
        return df.checkpoint(eager=True)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(dim: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table, once counted and measured, may be broadcast. At most ``max_rows`` + 1 rows are looked at."""
    size = dim.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b")).first()
    return size["n"] <= max_rows and (size["b"] or 0) <= max_bytes


def join_dimension(fact: DataFrame, dim: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a dimension table, broadcast only when it is ``small_enough``."""
    return fact.join(F.broadcast(dim) if small_enough(dim) else dim, keys, how)


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 UTC of a zone-less timestamp column, whatever the session's zone."""
    col = F.col(f"`{name}`")
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    stamp = col.cast("timestamp")
    if dict(df.dtypes)[name] == "timestamp_ntz" and zone not in ("UTC", "Etc/UTC", "GMT", "Z"):
        stamp = F.from_utc_timestamp(stamp, zone)
    return F.unix_micros(stamp)
