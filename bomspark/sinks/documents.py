"""Reports, pages and prompts to storage (R2, R4, R5 as files), byte for byte.

The builders in ``operators.report`` return ordered rows, never one value per
project.  Here they become text files: a folder per project whose files, concatenated
in the order of their names, are exactly the document.  Rows are dealt by ranges of
(project, order), so a project of any size is written by as many tasks as it needs and
is gathered in none; there are tasks for the folders as well as for the bytes.

Every part of a document ends with the same character (``>`` on a page, the line end in a prompt).
Spark's text writer puts a line separator behind every row; where it is used (``folders.write_texts``) that
character is its separator and the row is written without it: nothing is added.  A part that ends otherwise
stops the job.  Report lines have no line end of their own and get one
each.

``part_digests`` and ``file_digests`` compare what was built with what storage holds without
gathering a document.  A document is the sequence of its pieces, each up to and
including the separator.  With h the number made of the md5 of a piece's text, its digest is the sum of
h(j) * B^j modulo P over the pieces j from 0, and its size the number of bytes.  Digests
combine: that of two stretches is d1 + d2 * B^(pieces of the first), so each part (or
file block) is digested alone, and only (digest, pieces, bytes) triples are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bomspark.operators.ranking import ONE_TASK_ROWS, sum_before_in_group
from bomspark.session import bound_listing
from bomspark.sinks.folders import write_texts
from bomspark.sinks.landing import TASK_FILES

# Lines of one file may share a line number; their text decides then.
REPORT_ORDER = ("section_no", "file_id", "line_no", "line")
PART_ORDER = ("part_no", "chunk_no")
LINE_END, TAG_END = "\n", ">"
# Bytes of documents a writing task takes.
TASK_BYTES = 64 << 20
# Modulus (a Mersenne prime) and base of the digests.
P, B = (1 << 31) - 1, 1_000_003
# A power of B is the product of one entry of each table of powers, a table for each run of bits.
TABLE_BITS = 8


def _stopped(end: str) -> Column:
    return F.raise_error(F.lit(f"a part of a document does not end with {end!r}"))


def _ended(rows: DataFrame, value: str, end: str) -> Column:
    """The value without its closing ``end``; a value that has none stops the job."""
    v = F.col(value)
    return F.when(v.endswith(end), F.substring(v, F.lit(1), F.length(v) - len(end))).otherwise(_stopped(end))


def with_line_ends(lines: DataFrame, value: str = "line") -> DataFrame:
    """Report lines as parts of a document: each gets its line end."""
    return lines.withColumn(value, F.concat(value, F.lit(LINE_END)))


def write_documents(rows: DataFrame, out_dir: str, value: str, order: tuple[str, ...] = PART_ORDER,
                    mode: str = "overwrite", end: str = LINE_END) -> str:
    """Write the parts ``rows`` (project_id, the order columns, ``value``, which ends with
    ``end``) below ``out_dir``, one folder per project; returns ``out_dir``."""
    keys = ["project_id", *order]
    held = rows.agg(F.count_distinct("project_id").alias("projects"), F.sum(F.octet_length(value)).alias("bytes")).first()
    # a file costs its task far more than its bytes, so tasks are counted by both
    tasks = max(1, -(-held.projects // TASK_FILES), -(-(held.bytes or 0) // TASK_BYTES))
    whole = F.when(F.col(value).endswith(end), F.col(value)).otherwise(_stopped(end))
    dealt = rows.select(*keys, whole.alias("_written")).repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    write_texts(dealt.select("project_id", F.col("_written").alias("value")), out_dir, ["project_id"], mode, end)
    return out_dir


def read_document(spark: SparkSession, out_dir: str, project_id) -> str:
    """One project's document (for previews and tests)."""
    files = spark.read.format("binaryFile").load(f"{out_dir}/project_id={project_id}").select("path", "content").collect()
    return b"".join(bytes(r.content) for r in sorted(files, key=lambda r: r.path.rsplit("/", 1)[-1])).decode("utf-8")


def _power(exponent: str) -> str:
    """SQL of B to the power of a bigint expression that is not negative, modulo P.  B^(P - 1) is 1, so
    the exponent counts modulo P - 1, and its runs of TABLE_BITS bits look the factors up in
    constant arrays: a few look-ups a row, whatever the exponent."""
    entries, factors, b = 1 << TABLE_BITS, [], B
    for low in range(0, P.bit_length(), TABLE_BITS):
        powers = [1]
        for _ in range(entries - 1):
            powers.append(powers[-1] * b % P)
        table = f"array({', '.join(f'{x}L' for x in powers)})"
        factors.append(f"get({table}, cast(shiftright(({exponent}) % {P - 1}L, {low}) & {entries - 1}L as int))")
        b = powers[-1] * b % P
    out = factors[0]
    for f in factors[1:]:
        out = f"{out} * {f} % {P}L"
    return out


def _number(piece: str) -> str:
    """SQL of the number of a piece: 28 bits of its md5."""
    return f"cast(conv(substring(md5({piece}), 1, 7), 16, 10) as bigint)"


def _combined(parts: DataFrame, order: list[str], bound: int | None, one_task_rows: int) -> DataFrame:
    """project_id, pieces, bytes, digest from (project_id, order, pieces, bytes, digest) stretches."""
    placed = sum_before_in_group(parts, ["project_id"], order, {"pieces": "_before"}, bound, one_task_rows)
    return (placed.withColumn("_term", F.expr(f"digest * ({_power('_before')}) % {P}L"))
            .groupBy("project_id").agg(F.sum("pieces").alias("pieces"), F.sum("bytes").alias("bytes"),
                                       F.expr(f"sum(_term) % {P}L").alias("digest")))


def part_digests(rows: DataFrame, value: str, order: tuple[str, ...] = PART_ORDER, end: str = LINE_END,
                 bound: int | None = None, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """project_id, pieces, bytes, digest of the documents that ``rows`` make up
    (arguments as in ``write_documents``; ``bound``: rows of the largest project)."""
    pieces = F.split(_ended(rows, value, end), "[" + end + "]", -1)
    step = (f"aggregate(_pieces, named_struct('v', 0L, 'p', 1L), (a, x) -> named_struct("
            f"'v', (a.v + {_number('x')} * a.p) % {P}L, 'p', a.p * {B}L % {P}L)).v")
    parts = rows.select("project_id", *order, pieces.alias("_pieces"), F.octet_length(value).cast("bigint").alias("bytes"))
    parts = parts.select("project_id", *order, F.size("_pieces").cast("bigint").alias("pieces"), "bytes",
                         F.expr(step).alias("digest"))
    return _combined(parts, list(order), bound, one_task_rows)


def file_digests(spark: SparkSession, out_dir: str, key_type: str, end: str = LINE_END,
                 bound: int | None = None, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """project_id, pieces, bytes, digest of the documents below ``out_dir``; ``key_type`` is the
    SQL type of project_id.  A piece's power follows its place in the reading task, and the
    aggregate of a file block knows the first place, which is then divided out, so
    one pass without a sort digests each block."""
    bound_listing(spark)
    read = spark.read.schema(f"value string, project_id {key_type}").option("lineSep", end).text(out_dir)
    pieces = read.select("project_id", "value", F.col("_metadata.file_name").alias("_file"),
                         F.col("_metadata.file_block_start").alias("_start"),
                         (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("_n"))
    blocks = (pieces.withColumn("_term", F.expr(f"{_number('value')} * ({_power('_n')}) % {P}L"))
              .groupBy("project_id", "_file", "_start")
              .agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.octet_length("value") + len(end)).alias("bytes"),
                   F.min("_n").alias("_first"), F.expr(f"sum(_term) % {P}L").alias("_sum")))
    back = f"{P - 1}L - _first % {P - 1}L"  # B^(P - 1) is 1, so this power divides by B^_first
    blocks = blocks.select("project_id", "_file", "_start", "pieces", "bytes",
                           F.expr(f"_sum * ({_power(back)}) % {P}L").alias("digest"))
    return _combined(blocks, ["_file", "_start"], bound, one_task_rows)
