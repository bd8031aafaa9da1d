r"""Line dedup by content-defined chunks (native: DataFrame functions only).

A boundary stands before every line whose rolling hash, over it and the line
before, is 0 modulo ``divisor``, and before the first line; so an inserted line
moves only the nearest boundaries.  A chunk runs from a boundary over two
intervals to the second next boundary, so chunks overlap and a shared passage is
covered from its first boundary to its last.  With the default divisor of 1
every line opens a chunk, and a shared run of two lines is found whatever stands
around it; greater divisors make fewer, longer chunks and lose the rims of
passages.  A line of ``long_words`` words or more is a chunk by itself as well.

Chunks that occur again anywhere keep their first occurrence (least id, then
text hash, then position); the others' lines go once the bytes are found equal
to the first one's.  The earliest occurrence of a line always stays.

Defined results: a null text stays null and has no lines; chunks without a word
stay; a chunk that overlaps its own first occurrence stays; rows alike in id and
text share one verdict, so such repeats of a first occurrence stay with it; a
text may lose all its lines and is then empty; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stash

WORD = r"[^\x20\x09-\x0D]+"
LONG_WORDS = 50


def _barrier(df: DataFrame, **made: Column) -> DataFrame:
    """Adds columns behind a generator, so lambdas read them and never recompute them."""
    name = "__tv_" + "_".join(made)
    out = df.withColumn(name, F.explode(F.array(F.struct(*(c.alias(n) for n, c in made.items())))))
    return out.select(*(c for c in df.columns), *(F.col(f"{name}.{n}").alias(n) for n in made))


def row_key(id_col: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", id_col.cast("string"), F.md5(F.coalesce(text, F.lit(""))))))


def lines_of(text: Column) -> Column:
    return F.coalesce(F.split(text, "\n", -1), F.array().cast("array<string>"))


def chunked(docs: DataFrame, divisor: int, long_words: int) -> DataFrame:
    """docs(id, text) with rk (row key), lines and chunks: array of (first, n), lines counted from 0."""
    df = _barrier(docs.withColumn("rk", row_key(F.col("id"), F.col("text"))), lines=lines_of(F.col("text")))
    n, none = F.size("lines"), F.array().cast("array<int>")
    if divisor > 1:
        df = _barrier(df, hs=F.transform("lines", lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long")))
        opens = lambda i: (i == 0) | ((F.get("hs", i) * 31 + F.get("hs", i - 1)) % divisor == 0)
        df = _barrier(df, starts=F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), opens)).otherwise(none)).drop("hs")
        end = lambda k: F.coalesce(F.get("starts", k + 2), n)
        runs = F.transform("starts", lambda i, k: F.struct(i.alias("first"), (end(k) - i).alias("n")))
    else:
        runs = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(i.alias("first"), F.lit(2).alias("n"))))
        runs = F.coalesce(runs, F.array().cast("array<struct<first:int,n:int>>"))
    runs = F.filter(runs, lambda c: c["n"] > 1)
    # a line of so many words has as many characters and as many gaps but one
    long = F.filter(
        F.transform("lines", lambda x, i: F.when((F.length(x) >= 2 * long_words - 1) & (F.regexp_count(x, F.lit(WORD)) >= long_words), F.struct(i.alias("first"), F.lit(1).alias("n")))),
        lambda c: c.isNotNull(),
    )
    return _barrier(df, chunks=F.concat(runs, long))


def chunk_text(first: Column, n: Column) -> Column:
    # slice() copies the whole array each time
    return F.array_join(F.transform(F.sequence(first, first + n - 1), lambda i: F.get("lines", i)), "\n")


def chunk_hash(chunk: Column) -> Column:
    return F.unhex(F.md5(chunk))


def repeated_chunks(docs: DataFrame, divisor: int, long_words: int) -> tuple[DataFrame, list[DataFrame]]:
    """(rk, marks: array of (first, n, ck, is_first, rests)) for the rows of docs(id, text) with chunks met more than once.

    ``rests`` marks those that stay whatever their bytes: first occurrences and what overlaps them.
    The tables that it reads come second.
    """
    # hashed inside the row: a row for each chunk would carry all lines of its text along
    body = lambda c: chunk_text(c["first"], c["n"])
    hashed = F.transform("chunks", lambda c: F.when(F.regexp_like(body(c), F.lit(WORD)), F.struct(c["first"].alias("first"), c["n"].alias("n"), chunk_hash(body(c)).alias("ck"))))
    light = chunked(docs, divisor, long_words).select("id", "rk", F.explode(F.filter(hashed, lambda c: c.isNotNull())).alias("c")).select("id", "rk", "c.*")
    light = stash(light, "line-chunks")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "rk", "first")
    again = light.groupBy("ck").agg(F.count("*").alias("times"), F.min(order).alias("head")).where("times > 1").select("ck", "head.rk", "head.first")
    again = stash(again.withColumnsRenamed({"rk": "head_rk", "first": "head_first"}), "line-repeats")  # joined from a table, a frequent chunk's rows can be split
    own = F.col("rk") == F.col("head_rk")
    mark = F.struct("first", "n", "ck", (own & (F.col("first") == F.col("head_first"))).alias("is_first"), (own & (F.abs(F.col("first") - F.col("head_first")) < F.col("n"))).alias("rests"))
    return light.join(again, "ck").select("rk", mark.alias("mark")).groupBy("rk").agg(F.collect_set("mark").alias("marks")), [light, again]


def differing(marked: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(rk, bad: array of (first, n)): chunks whose bytes are not those of the first occurrence with their hash; then the tables read."""
    lines = _barrier(marked.where("marks is not null"), lines=lines_of(F.col("text")))
    whole = F.transform("marks", lambda m: F.struct(m["first"].alias("first"), m["n"].alias("n"), m["ck"].alias("ck"), m["is_first"].alias("is_first"), m["rests"].alias("rests"), chunk_text(m["first"], m["n"]).alias("chunk")))
    texts = lines.select("rk", F.explode(whole).alias("mark")).select("rk", "mark.*")
    texts = stash(texts.where("is_first or not rests"), "line-marks")
    firsts = stash(texts.where("is_first").select("ck", F.col("chunk").alias("first_chunk")).distinct(), "line-firsts")
    other = texts.where("not is_first").join(firsts, "ck", "left").where("first_chunk is null or chunk <> first_chunk")
    return other.groupBy("rk").agg(F.collect_set(F.struct("first", "n")).alias("bad")), [texts, firsts]


def dedup_line_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = 1, long_words: int = LONG_WORDS) -> DataFrame:
    """The rows of ``docs`` with a struct ``__tv_lines``: text, n_lines, n_removed_lines, n_removed_chunks."""
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    marks, held = repeated_chunks(docs.select(ident.alias("id"), text.alias("text")), divisor, long_words)
    row = docs.select(row_key(ident, text).alias("rk"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    marked = stash(row.join(marks, "rk", "left"), "line-marked")
    discard(*held)
    # no chunk differs unless two texts share a hash: a small table, read with its size known
    other, held = differing(marked.select("rk", F.col(f"row.`{text_col}`").alias("text"), "marks"))
    bad = stash(other, "line-differing")
    discard(*held)
    gone = F.transform(F.filter("marks", lambda m: ~m["rests"]), lambda m: F.struct(m["first"].alias("first"), m["n"].alias("n")))
    gone = F.when(F.col("bad").isNull(), gone).otherwise(F.filter(gone, lambda c: ~F.array_contains("bad", c)))
    text = F.col(f"row.`{text_col}`")
    df = _barrier(marked.join(bad, "rk", "left"), gone=F.when(F.coalesce(F.size(gone), F.lit(0)) > 0, gone), n_lines=F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)))
    places = F.flatten(F.transform("gone", lambda c: F.sequence(c["first"], c["first"] + c["n"] - 1)))
    df = _barrier(df, kept=F.when(F.col("gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), places)))
    df = _barrier(df, lines=F.when(F.col("gone").isNotNull(), lines_of(text)))
    out = F.struct(
        F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n")).alias("text"),
        F.col("n_lines").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("kept")).cast("long").alias("n_removed_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_removed_chunks"),
    )
    return df.select("row", out.alias("__tv_lines")).select("row.*", "__tv_lines")
