"""Helpers that the training-data operators share: shared folder, shipping of code, word hashing."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp()) / "noticeboard_ship.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(out))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or a local one where that is unset and all is one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/noticeboard-{spark.sparkContext.applicationId}"


_SCRATCH: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut and no later step computes it again."""
    path = "/".join([shared_dir(df.sparkSession), *_SCRATCH[-1:], f"{name}-{uuid.uuid4().hex}"])
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete a table that `stored` has made and that nothing reads any more."""
    _delete(df.sparkSession, df.stored_at)


@contextmanager
def scratch(spark: SparkSession):
    """What is stored inside the block goes when it ends, so its result must be written before, and elsewhere."""
    _SCRATCH.append(f"scratch-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        _delete(spark, f"{shared_dir(spark)}/{_SCRATCH.pop()}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have (in any letter case)."""
    have = {c.lower() for c in df.columns}
    while base.lower() in have:
        base = f"_{base}"
    return base


def slices(b: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that only few texts are Python strings at a time."""
    for i in range(0, b.num_rows, rows):
        yield b.slice(i, rows)


def map_arrow(df: DataFrame, fn: Callable, schema: str, *, keep: bool = False) -> DataFrame:
    """fn takes one pyarrow RecordBatch and returns the new columns as a list of lists or arrays.

    keep: the columns of df stay, in front of the new ones, whose names must be free in df (``free_name``).
    """
    ship(df.sparkSession)
    new = _schema(schema)
    target = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in new.fields])
    out = type(new)([*df.schema.fields, *new.fields]) if keep else new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for b in slices(b):
                cols = [c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(fn(b), target, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.columns if keep else ()), *cols], names=[*(b.schema.names if keep else ()), *target.names])

    return df.mapInArrow(run, out)


def _schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


_SLOT: list = [None, None]


def cache(name: str, make: Callable):
    """What one operator remembers in this worker process. There is one at a time: the next operator's takes its place."""
    if _SLOT[0] != name:
        _SLOT[:] = [None, None]
        _SLOT[:] = [name, make()]
    return _SLOT[1]


def space_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; bytes.lower() and bytes.split() touch ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit depends on every bit."""
    h = h ^ (h >> U(31))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


STEP = U(0x9E3779B97F4A7C15)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd number modulo 2^64."""
    if len(_POWERS.get(base, ())) < n:
        _POWERS[base] = np.cumprod(np.r_[U(1), np.full(max(n, 1024), U(base))], dtype=U)
    return _POWERS[base][:n]


BASE = int(STEP)
INVERSE = pow(BASE, -1, 2**64)
#: bytes.translate: A-Z become a-z, white space becomes spaces
PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_OF_BYTE = mixed(np.arange(1, 257, dtype=U) * STEP)
_PIECE = 1 << 19


def word_places(data: bytes, plain: bytes = PLAIN) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text in UTF-8 start and end; plain: a table of bytes.translate that turns what is between words into spaces."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = np.frombuffer(data.translate(plain), np.uint8) != 32
    steps = np.diff(word)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def word_hashes(texts: list[str | None], plain: bytes = PLAIN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (by default `[^\\x20\\x09-\\x0D]+`, A-Z as a-z) of all texts in a row, and at which word each text ends.

    A word's hash is a polynomial over its bytes, taken from running sums over pieces of half a megabyte.
    """
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = b" ".join(raw).translate(plain)
    borders = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = at + _PIECE
        if end < len(data):
            end = data.rfind(b" ", at, end) + 1 or data.find(b" ", end) + 1 or len(data)
        first, last = word_places(data[at:end], plain)
        b = np.frombuffer(data, np.uint8, min(end, len(data)) - at, at)
        sums = np.zeros(len(b) + 1, U)
        np.cumsum(_OF_BYTE[b] * powers(BASE, len(b)), out=sums[1:])
        hashes.append((sums[last] - sums[first]) * powers(INVERSE, len(b) + 1)[first])
        starts.append(first + at)
        at = end
    if not hashes:
        return np.zeros(0, U), np.zeros(len(texts), np.int64)
    return mixed(np.concatenate(hashes)), np.searchsorted(np.concatenate(starts), borders)


def grams(a: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k of a's values (in order); a must have k at least."""
    n = len(a) - k + 1
    h = np.zeros(n, U)
    for j in range(k):
        h = h * STEP + a[j : j + n]
    return mixed(h)


def crc_of_id(col) -> object:
    """crc32 of the id as text, for folds."""
    return F.crc32(F.col(col).cast("string").cast("binary")) if isinstance(col, str) else F.crc32(col.cast("string").cast("binary"))


def cleanup(spark: SparkSession) -> None:
    """Delete the tables that this application has stored in the shared folder. Results that read them must be written before."""
    _delete(spark, shared_dir(spark))
