"""What several operators need from the session: written tables, row keys and names of columns."""

from __future__ import annotations

from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.storage import new_path

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(df: DataFrame, tag: str) -> DataFrame:
    """The same rows from a table in the shared folder. Cuts the lineage: a lost executor loses none of them."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more, from whatever store they are in."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that name a row by its id and text. Rows with equal ids and equal texts share them."""
    halves = F.xxhash64(doc_id, text), F.xxhash64(F.lit("row"), text, doc_id)
    return F.unhex(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in halves)))


def key_bits(keys: pa.Array) -> np.ndarray:
    """The first eight bytes of each row key."""
    body = np.frombuffer(keys.buffers()[2] or b"", np.uint64)[2 * keys.offset :: 2] if len(keys) else np.zeros(0, np.uint64)
    return body[: len(keys)]


def fresh(columns: list[str], name: str) -> str:
    """A name like the one given that is none of the columns', upper or lower case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
