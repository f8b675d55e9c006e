"""State by key for streams: a session whose store can hold it, and the first row of every key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings that a stream's own session takes over.
KEPT = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.checkpoint.dir")
_MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with RocksDB as its state store; the given one stays as it is."""
    session = spark.newSession()
    session.conf.set(PROVIDER, ROCKSDB)
    for name in KEPT:
        if (value := spark.conf.get(name, None)) is not None and session.conf.get(name, None) != value:
            session.conf.set(name, value)
    return session


class _First(StatefulProcessor):
    """Lets one row of a key through, ever: the first of those that come together."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, best, row = self.seen.exists(), None, None
        for part in rows:
            if not known and len(part):
                part = part.set_axis([*part.columns[:-2], "_order", "_row"], axis=1)  # Spark names them by place after a restart
                at = part["_order"].idxmin()
                if best is None or part["_order"][at] < best:
                    best, row = part["_order"][at], part["_row"][at]
        if not known and row is not None:
            self.seen.update((True,))
            yield pd.DataFrame({"_row": [row]})

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        pass


def _thinned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keys = [c for c in b.columns if c.startswith("_key")]
        yield b.sort_values("_order", kind="stable").drop_duplicates(keys)


def first_of_key(stream: DataFrame, keys: Sequence[str], known: DataFrame, order: str = "ord") -> DataFrame:
    """The first row of every key that ``known`` does not have; all later ones of the key are dropped, however late they come.

    One state value for each key says that it has been met. The keys of ``known`` are put into the store as the stream's first
    micro-batch starts and are not read again, so that a micro-batch costs what its own keys cost, whatever has been met
    before. Of rows that come together the one with the lowest ``order`` counts (null first). Repeats are thinned in each
    scan task, so of a frequent key little reaches the state. Rows travel as JSON beside their key, with all their types kept.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    own = {n: F.col(c) for n, c in zip(names, keys)}
    row = F.to_json(F.struct(*stream.columns), _MICROS)
    keyed = stream.select(*[c.alias(n) for n, c in own.items()], F.coalesce(F.col(order).cast("long"), F.lit(-(2**63))).alias("_order"), row.alias("_row"))
    thin = keyed.mapInPandas(_thinned, keyed.schema)
    start = known.select(*[F.col(c).alias(n) for n, c in zip(names, keys)]).distinct().groupBy(*names)
    first = thin.groupBy(*names).transformWithStateInPandas(_First(), "_row string", "Append", "None", initialState=start)
    return first.select(F.from_json("_row", stream.schema, _MICROS).alias("r")).select("r.*")
