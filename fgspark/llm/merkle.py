"""Document fingerprints: a Merkle tree over sections, paragraphs and their pieces. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A piece of a paragraph: up to 64 characters without an end mark, and the end marks after them.
PIECE = r"[^.!?]{1,64}[.!?]*|[.!?]+"
#: Paragraphs up to and with one whose hash ends in 0 to 3 are a section, so an edit moves no section border but its own.
SECTION = r"(?:[0-9a-f]{15}[4-9a-f])*(?:[0-9a-f]{15}[0-3]|$)"
#: Ranges of the order by id for each shuffle partition.
RANGES = 4


def _hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value taken once."""
    return F.transform(F.array(value), use)[0]


def fingerprint(text: Column) -> Column:
    """The tree as a string, root|section/section/..., a section paragraph;paragraph, a paragraph hash:piece,piece.

    Paragraphs are the text's lines. A node's hash is that of its children's hashes (16 hex digits each; the root 64),
    so equal roots mean equal texts and unequal hashes on the way down lead to the edits. Equal texts have equal
    fingerprints. An empty text is one empty paragraph.
    """
    pieces = F.transform(F.split(text, "\n", -1), lambda line: F.array_join(F.transform(F.regexp_extract_all(line, F.lit(PIECE), F.lit(0)), _hash), ","))
    paragraphs = F.transform(pieces, lambda p: F.concat(_hash(F.concat(F.lit("p"), p)), F.lit(":"), p))
    return _let(paragraphs, _tree)


def _tree(paragraphs: Column) -> Column:
    listed = F.array_join(F.transform(paragraphs, lambda p: F.substring(p, 1, 16)), "")
    sections = F.filter(F.regexp_extract_all(listed, F.lit(SECTION), F.lit(0)), lambda s: F.length(s) > 0)
    root = F.sha2(F.concat(F.lit("r"), F.array_join(F.transform(sections, lambda s: _hash(F.concat(F.lit("s"), s))), "")), 256)
    ends = lambda p: F.when(F.substring(p, 16, 1).isin("0", "1", "2", "3"), "/").otherwise(";")
    return F.concat(root, F.lit("|"), F.array_join(F.transform(paragraphs, lambda p: F.concat(p, ends(p))), ""))


def branches(print_: Column) -> Column:
    """The piece hashes of a fingerprint, each once."""
    return F.array_distinct(F.regexp_extract_all(print_, F.lit(r"(?<=[:,])[0-9a-f]{16}"), F.lit(0)))


def likeness(a: Column, b: Column) -> Column:
    """Share of common pieces of two fingerprints (Dice), 1 for equal roots."""
    x, y = branches(a), branches(b)
    total = F.size(x) + F.size(y)
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), 1.0).when(total == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total)


def edited_paragraphs(a: Column, b: Column) -> Column:
    """struct(start, stop): the paragraphs of b (from 0) between those that both have at the head and those at the tail.

    Whole branches that agree are passed over by their hashes alone; start = stop where nothing of b is new.
    """
    hashes = lambda c: F.regexp_extract_all(c, F.lit(r"[0-9a-f]{16}(?=:)"), F.lit(0))

    def agree(x: Column, y: Column, most: Column) -> Column:
        same = F.zip_with(F.slice(x, F.lit(1), most), F.slice(y, F.lit(1), most), lambda u, v: u == v)
        first = F.array_position(same, F.lit(False)).cast("int")
        return F.when(first > 0, first - 1).otherwise(most)

    def found(p: Column) -> Column:
        n, m = F.size(p["a"]), F.size(p["b"])
        head = agree(p["a"], p["b"], F.least(n, m))
        return _let(head, lambda h: F.struct(h.alias("start"), (m - agree(F.reverse(p["a"]), F.reverse(p["b"]), F.least(n, m) - h)).alias("stop")))

    return _let(F.struct(hashes(a).alias("a"), hashes(b).alias("b")), found)


def with_next(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """docs with a struct `next` of the columns of the row with the next smaller id; after the last comes the first.

    A first job sorts the keys alone into ranges of equally many rows and takes each range's first key, so gaps between
    ids are no matter; at most RANGES for each shuffle partition come to the driver. A window runs in each range alone,
    and a range's last row takes the first row of the next range. Null ids come last. Rows of equal id follow each other
    by the columns' hash; only rows alike in both have to be in one range.
    """
    spark = docs.sparkSession
    ordered = lambda c: F.lpad(F.hex(c.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")  # noqa: E731  text that sorts as the numbers do
    id_ = F.col(id_col).cast("long")
    key = F.concat(F.when(id_.isNull(), "1").otherwise("0"), ordered(F.bitwise_not(F.coalesce(id_, F.lit(0)))), ordered(F.xxhash64(*columns)))
    rows = docs.withColumn("__key", key)
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_keys = rows.select("__key").repartitionByRange(n, "__key")
    first = sorted(r.k for r in sorted_keys.groupBy(F.spark_partition_id().alias("p")).agg(F.min("__key").alias("k")).collect()) or [""]
    listed, step = lambda keys: F.split(F.lit(" ".join(keys)), " "), max(1, int(len(first) ** 0.5))  # noqa: E731  one literal, however many
    bounds = listed(first)
    below = lambda keys: F.size(F.filter(keys, lambda b: b <= F.col("__key")))
    coarse = below(listed(first[::step])) - 1
    rows = rows.withColumn("__coarse", F.greatest(coarse, F.lit(0)))
    rows = rows.withColumn("__range", F.col("__coarse") * step + below(F.slice(bounds, F.col("__coarse") * step + 1, F.lit(step))) - 1).drop("__coarse")
    row = F.struct(*columns)
    order = Window.partitionBy("__range").orderBy("__key")
    # the first rows of ranges come from the same shuffle as the rows themselves
    heads = rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").select(F.pmod(F.col("__range") - 1, F.lit(len(first))).alias("__range"), row.alias("__head"))
    led = rows.withColumn("__lead", F.lead(row).over(order))
    return led.join(heads, "__range", "left").withColumn("next", F.coalesce("__lead", "__head")).drop("__range", "__key", "__lead", "__head")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_start, edited_stop.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next document's, by descending doc_id, after the last the first. edited_start and edited_stop give the paragraphs
    of the edited text that its tree tells apart from the text's. Null text: empty. Null ids: last. Repeated rows
    stay, each followed by the other. A single row is its own next. An empty table gives no rows. Other columns are not
    read. One shuffle of the texts.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(own, "doc_id", ["text"])
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("next.text")).alias("__next"), F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half)).alias("__edited"))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("__edited")))
    rows = rows.withColumn("__at", edited_paragraphs(F.col("fingerprint"), F.col("edited_fingerprint")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("__next")).alias("near_next"),
        F.col("__at.start").alias("edited_start"), F.col("__at.stop").alias("edited_stop"),
    )
