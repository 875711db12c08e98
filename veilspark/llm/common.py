"""What several operators share."""

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts of one Arrow batch are handled in pieces of about so many characters; rows of a batch that are Python texts at once.
PIECE_CHARS, ROWS = 8_000_000, 1024


def held_out(doc_id: Column) -> Column:
    """Whether labels of this document must not be learned: crc32 of the id as text leaves 0 when divided by 5. Null ids: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def pieces(texts: list, limit: int = PIECE_CHARS) -> Iterator[list]:
    """Consecutive runs of texts of about limit characters; one longer text is a run of its own."""
    run, size = [], 0
    for x in texts:
        n = len(x) if x else 0
        if run and size + n > limit:
            yield run
            run, size = [], 0
        run.append(x)
        size += n
    if run:
        yield run


def batch_pieces(column: pa.Array, limit: int = PIECE_CHARS) -> Iterator[list]:
    """pieces() of a column of texts, of which only some rows are Python texts at once."""
    for at in range(0, len(column), ROWS):
        yield from pieces(column.slice(at, ROWS).to_pylist(), limit)


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work, a function of a task's batches, after which its worker gives freed memory back to the system.

    Workers outlive their tasks and wait beside the executor while later stages run, with all that they have not given back.
    """

    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # in the GNU C library only
            if trim:
                trim(0)

    return run


def per_text(make: Callable[[], Callable[[list], list[tuple]]], fields: T.StructType, piece: int = PIECE_CHARS) -> Callable[[Column], Column]:
    """A column function from text to a struct.

    make() runs once in each task and gives a function from a list of texts (null: None) to rows of fields. Texts arrive
    in Arrow batches; the function sees them in pieces of about `piece` characters.
    """
    arrow = pa.schema([pa.field(f.name, {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32())}[f.dataType.simpleString()]) for f in fields])

    def each(batches):
        work = make()
        for batch in batches:
            rows = []
            for run_ in batch_pieces(batch, piece):
                rows.extend(work(run_))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow]
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], fields=list(arrow))
            del rows, cols, batch
            pa.default_memory_pool().release_unused()

    run = lean(each)
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, fields)


def free_name(df: DataFrame, wish: str) -> str:
    """wish, or wish with underscores before it until no column of df has that name."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def doc_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever else docs has; a column `text` of another type is read as text."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
