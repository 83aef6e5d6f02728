"""Tables in and out: files, literal rows, prepared (cached) sources and batches of pipelines over one source."""

from __future__ import annotations

import asyncio
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quernix.plans import codec
from quernix.plans import steps as S
from quernix.plans.engine import embedded, finish, run


def parquet(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """Named tables of a folder, ready to be passed as ``tables``."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def csv(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """A typed CSV source; a cell that does not parse is refused, not nulled."""
    return spark.read.options(mode="FAILFAST", header=True, **options).schema(schema).csv(path)


def from_rows(spark: SparkSession, schema: tuple[tuple, ...], rows) -> DataFrame:
    """Positional rows; a ragged one is refused."""
    return finish(embedded(spark, S.Embedded(tuple(schema), tuple(map(tuple, rows)))))


def from_json(spark: SparkSession, text: str) -> DataFrame:
    """A table in the column codec."""
    return finish(embedded(spark, codec.decode_source(codec.loads(text))))


def to_json(df: DataFrame, limit: int = 100_000) -> str:
    """The column codec of a small table; larger ones are refused."""
    from quernix.errors import CodecError
    from quernix.functions.compile import schema_of

    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise CodecError(f"more than {limit} rows; write files instead")
    schema = tuple((n, f.type, *([f.unit] if f.unit else [])) for n, f in schema_of(df.schema).items())
    return codec.encode_table(S.Embedded(schema, tuple(map(tuple, rows))))


def aggregate_cells(spark: SparkSession, fn: str, kind: str, cells: list):
    """One aggregate of a list of cells of one type; of none, count is 0 and the others are null."""
    rows = tuple((c,) for c in cells) or ((None,),)
    out = run(spark, (S.GroupBy((), (S.Agg("v", fn, "c"),)),), S.Embedded((("c", kind),), rows)).first()["v"]
    return out


def eval_in_row(spark: SparkSession, e, schema: tuple[tuple, ...], row: tuple, env: dict | None = None):
    """The value of an expression in one row."""
    return run(spark, (S.Derive("__value", e),), S.Embedded(tuple(schema), (tuple(row),)), env=env).first()["__value"]


@dataclass
class Prepared:
    """A source that is read once and used by many pipelines."""

    df: DataFrame

    def run(self, steps, **kw) -> DataFrame:
        return run(self.df.sparkSession, steps, self.df, **kw)

    def run_prepared(self, steps, **kw) -> Prepared:
        return prepare(self.run(steps, **kw))

    def run_many(self, pipelines: dict[str, tuple], workers: int = 4, **kw) -> dict[str, Prepared]:
        """Independent pipelines over this source, submitted side by side and held ready."""

        def one(item):
            p = prepare(self.run(item[1], **kw))
            p.df.count()
            return item[0], p

        with ThreadPoolExecutor(workers) as pool:
            return dict(pool.map(one, pipelines.items()))

    async def run_async(self, steps, **kw) -> Prepared:
        return await asyncio.to_thread(self.run_prepared, steps, **kw)

    def release(self) -> None:
        self.df.unpersist()


def prepare(df: DataFrame) -> Prepared:
    return Prepared(df.persist())
