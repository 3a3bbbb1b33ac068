"""Labelled datasets: CSV in and out, stored features, and the four source layouts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgauge.functions.keys import id_bucket
from quillgauge.functions.text import strip_parenthetical
from quillgauge.operators.ordering import number_rows
from quillgauge.operators.rows import load_normalise, remove_empty, unpivot_flags
from quillgauge.session import stored

# Class numbers of the news source.
NEWS_CLASSES = {1: "World", 2: "Sports", 3: "Business", 4: "Sci/Tech"}

# Emotions kept from the emotion source.
EMOTIONS = ("gratitude", "nervousness", "desire", "grief", "surprise")


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = (), sep: str = ",", rows_per_file: int = 0) -> None:
    """CSV with a header, doubled quotes inside values and doubled backslashes.

    With ``rows_per_file`` no file has more rows; the names of a task's files follow the order of its rows.
    """
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in partition_by]
    escaped = df.withColumns({c: F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")) for c in strings})
    (
        escaped.write.partitionBy(*partition_by)
        .options(header=True, quote='"', escape='"', sep=sep, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .option("maxRecordsPerFile", rows_per_file)
        .csv(path)
    )


# Structure and escaped characters of a CSV text are written as this character and a letter. The
# character itself is written so too, hence any text comes back as it was.
_MARK = "\ufdd0"
_RECORD, _FIELD, _QUOTED = _MARK + "r", _MARK + "f", _MARK + "q"


def _marked(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), pairs, text)


def _escapes(sep: str) -> list[tuple[str, str]]:
    """A backslash and what follows it: pairs first, so that what is left over stands alone."""
    return [("\\\\", _MARK + "b"), ('\\"', _MARK + "c"), ("\\" + sep, _MARK + "d"), ("\\\n", _MARK + "n"), ("\\\r", _MARK + "m"), ("\\", "")]


def _records(parts: Column, sep: str) -> Column:
    """The records of a CSV text cut at its quotes, as arrays of marked values; null where a quote is not closed.

    The quoted parts are at the odd places. An empty part between two others outside of quotes is a
    doubled quote; separators and line ends count outside only. ``parts`` is to be a column of its
    own: every part asks for their number.
    """
    last = F.size(parts) - 1
    structure = [("\r\n", _RECORD), ("\n", _RECORD), ("\r", _RECORD), (sep, _FIELD)]

    def piece(part: Column, i: Column) -> Column:
        doubled = (part == "") & (i > 0) & (i < last)
        return F.when(i % 2 == 1, F.concat(F.lit(_QUOTED), part)).when(doubled, '"').otherwise(_marked(part, structure))

    whole = F.array_join(F.transform(parts, piece), "")
    filled = F.filter(F.split(whole, _RECORD, -1), lambda line: line != "")
    return F.when(last % 2 == 0, F.transform(filled, lambda line: F.split(line, _FIELD, -1)))


def _value(marked: Column, sep: str) -> Column:
    plain = [(_QUOTED, ""), (_MARK + "b", "\\"), (_MARK + "c", '"'), (_MARK + "d", sep), (_MARK + "n", "\n"), (_MARK + "m", "\r"), (_MARK + "a", _MARK)]
    return F.nullif(_marked(marked, plain), F.lit(""))


def read_csv(spark: SparkSession, path: str | list[str], schema: str, sep: str = ",", origin: bool = False) -> DataFrame:
    """Read CSV whose backslashes escape the next character; an empty value is null, quoted or not.

    Quotes inside values may be doubled or escaped, also within one file, which Spark's own reader
    cannot tell apart; so files come as whole texts and are cut up by column expressions. A file is
    malformed if a quote is not closed or a record has more values than the schema. A file that is
    malformed with escapes, or loses records to a backslash that ends a value, cannot have been
    written that way; its values are taken as they stand. One that is malformed both ways fails.
    A quote always begins or ends quoting, also within an unquoted value, which writers never leave
    so. Empty lines are passed over, missing values are null, the first record is the header.

    Values with line breaks keep a file in one piece, so a dataset of size should come in many
    files. With ``origin`` each row has its ``file`` and its place there, ``at``.
    """
    fields = T.StructType.fromDDL(schema)

    def sound(records: Column) -> Column:
        return F.coalesce(F.forall(records, lambda r: F.size(r) <= len(fields)), F.lit(False))

    content = F.replace("value", F.lit(_MARK), F.lit(_MARK + "a"))
    # Paths come percent-encoded, with a plus as itself.
    file = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    texts = spark.read.text(path, wholetext=True).select(file.alias("file"), content.alias("content"))
    # Escapes of an odd run at the very end of a text have nothing to escape.
    torn = F.col("content").rlike(r"(?<!\\)(\\\\)*+\\\z")
    cut = texts.select(
        "file",
        F.when(~torn, F.split(_marked(F.col("content"), _escapes(sep)), '"', -1)).alias("escaped"),
        F.split("content", '"', -1).alias("plain"),
    )
    both = cut.select("file", *[_records(F.col(c), sep).alias(c) for c in ("escaped", "plain")])
    ends = F.exists("plain", lambda r: F.exists(r, lambda v: v.rlike(r"(?<!\\)(\\\\)*+\\\z")))
    loses = sound(F.col("plain")) & (F.size("plain") > F.size("escaped")) & ends
    malformed = F.raise_error(F.concat(F.lit("malformed CSV: "), "file"))
    chosen = (
        F.when(sound(F.col("escaped")) & ~F.coalesce(loses, F.lit(False)), F.col("escaped"))
        .when(sound(F.col("plain")), F.col("plain"))
        .otherwise(malformed.cast("array<array<string>>"))
    )
    rows = both.select("file", F.posexplode(chosen).alias("at", "record")).filter(F.col("at") > 0)
    values = [_value(F.get("record", F.lit(i)), sep).cast(f.dataType).alias(f.name) for i, f in enumerate(fields)]
    places = ["file", (F.col("at") - 1).cast("bigint").alias("at")] if origin else []
    return rows.select(*values, *places)


def load(spark: SparkSession, path: str | list[str], dual: bool = False) -> DataFrame:
    """A labelled CSV, normalised: (text, label[, other_text])."""
    return load_normalise(read_csv(spark, path, "text string, label string" + (", other_text string" if dual else "")))


def load_many(spark: SparkSession, paths: Sequence[str], dual: bool = False) -> DataFrame:
    """Many labelled CSVs as the long table: (dataset_id, row_id, text, label[, other_text]).

    Each path is a file or a folder of files and is the id of its dataset. Rows are normalised and
    numbered from 0 in the order of file and place, so the ids are the same on every run.
    """
    columns = "text string, label string" + (", other_text string" if dual else "")
    rows = read_csv(spark, list(paths), columns, origin=True)
    # Local names come with and without a scheme.
    listed = spark.createDataFrame([(p.rstrip("/"),) for p in paths], "dataset_id string").distinct()
    listed = listed.withColumn("__place", F.regexp_replace("dataset_id", "^file:/+", "/"))
    file = F.regexp_replace("file", "^file:/+", "/")
    folder = F.regexp_replace("file", "/[^/]*$", "")
    placed = rows.withColumn("file", file).withColumn("__place", F.explode(F.array("file", folder)))
    # The names come from the driver, so they fit a broadcast; the texts are not shuffled to meet them.
    found = placed.join(F.broadcast(listed), "__place").drop("__place")
    block = F.struct("file", id_bucket("at").alias("block"))
    # The files are parsed once; numbering reads them twice.
    clean = stored(load_normalise(found), "loaded")
    numbered = number_rows(clean, ["dataset_id"], ["file", "at"], block, name="row_id")
    others = ["other_text"] if dual else []
    return numbered.select("dataset_id", (F.col("row_id") - 1).alias("row_id"), "text", "label", *others)


def load_manifest(spark: SparkSession, manifest: DataFrame, dual: bool = False) -> DataFrame:
    """The datasets that a manifest names (``stores.manifest_datasets``), with run settings and stage depth."""
    named = manifest.select(F.regexp_replace("path", "/+$", "").alias("dataset_id"), "settings", "depth")
    # One name per dataset of the run goes to the driver: a reader is made of names.
    paths = [r["dataset_id"] for r in named.select("dataset_id").distinct().collect()]
    return load_many(spark, paths, dual).join(named, "dataset_id")


def write_features(df: DataFrame, path: str) -> None:
    """Rows with their derived columns (vectors, tokens) as Parquet, one folder per dataset."""
    df.write.partitionBy("dataset_id").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def news(df: DataFrame, class_column: str, title: str) -> DataFrame:
    """Class numbers to names; a trailing parenthetical goes; rows left empty go."""
    names = F.create_map(*[F.lit(v) for item in NEWS_CLASSES.items() for v in item])
    out = df.withColumn("label", F.element_at(names, F.col(class_column).cast("int")))
    return remove_empty(out.withColumn("text", strip_parenthetical(title)))


def questions(df: DataFrame, drop: str, title: str, topic: str) -> DataFrame:
    """Drop one column, then every row with a null; title and topic become text and label."""
    out = df.drop(drop).dropna(how="any")
    return remove_empty(out.withColumnRenamed(title, "text").withColumnRenamed(topic, "label"))


def emotions(df: DataFrame, flags: Sequence[str] = EMOTIONS, unclear: str = "example_very_unclear") -> DataFrame:
    """One-hot emotions to labels, without the unclear examples."""
    return remove_empty(unpivot_flags(df, flags, F.col(unclear)).drop(unclear))


def sentiment(df: DataFrame, number: str, sentence: str) -> DataFrame:
    label = F.when(F.col(number) == 1, "positive").otherwise("negative")
    return remove_empty(df.withColumn("label", label).withColumnRenamed(sentence, "text"))
