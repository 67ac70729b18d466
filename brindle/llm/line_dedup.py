"""Line dedup (operator 6): explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position.

Only two 64-bit hashes of a line leave its task, never its text. Counts combine on the map side, so a line that a third of all
documents hold is one row a task. When lines meet the table of common keys, those of the hottest keys (fewer than HOTTEST, whatever
the input) are dealt over SALTS parts, so no task holds a hot line. The positions to drop come back to a document by its id and a hash of its text: rows that
agree in both are the same document and get the same answer, so repeats need no extra key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm._util import stored, text_of, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\u000b\f\r"
#: A key is hot if it holds more than 1 / HOTTEST of what all common keys hold; its lines are dealt over SALTS parts.
HOTTEST, SALTS = 1000, 256


def line_key(line: Column) -> Column:
    """White space of ASCII stripped at both ends, A-Z lower-cased. Where all is ASCII, lower() says the same at less cost."""
    line = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col rid of every line whose key has min_chars code points and lies in min_docs documents.

    Adds _n_lines and _n_dropped (long; columns of these names are replaced). Rows and other columns are all kept. Null or empty text is one empty line, and becomes
    the empty text. Documents are told apart by id_col (null counts as one document). An empty table gives an empty one.
    """
    lines = F.split(text_of(text_col), "\n", -1)
    keyed = docs.select(F.col(id_col).alias("i"), F.xxhash64(text_of(text_col)).alias("x"), F.xxhash64(F.lit(3), text_of(text_col)).alias("y"), lines.alias("lines"))
    exploded = keyed.select("i", "x", "y", F.posexplode("lines").alias("p", "line"))
    # the key is as long as the stripped line: the filter needs no second lower-casing
    exploded = exploded.where(F.char_length(F.btrim("line", F.lit(BLANKS))) >= min_chars).select("i", "x", "y", "p", line_key(F.col("line")).alias("k"))
    exploded = exploded.select("i", "x", "y", "p", F.xxhash64("k").alias("h"), F.xxhash64(F.lit(1), F.col("k")).alias("g"))
    common = exploded.select("h", "g", "i").distinct().groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    common = stored(common, "common-lines")
    most = (common.agg(F.sum("n").alias("n")).first()["n"] or 0) // HOTTEST
    hot = F.col("h").isin([r["h"] for r in common.where(F.col("n") > F.greatest(F.lit(most), F.lit(100))).select("h").distinct().collect()])
    salted = exploded.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("i", "p"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    facts = common.select("h", "g", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    gone = salted.join(facts.hint("merge"), ["h", "g", "salt"], "left_semi").groupBy("i", "x", "y").agg(F.collect_set("p").alias("gone"))
    x, y, i, gx, gy, g = unused(docs, "_x", "_y", "_i", "_gx", "_gy", "_gone")
    left = docs.withColumns({x: F.xxhash64(text_of(text_col)), y: F.xxhash64(F.lit(3), text_of(text_col))})
    both = left.join(gone.select(F.col("i").alias(i), F.col("x").alias(gx), F.col("y").alias(gy), F.col("gone").alias(g)), F.col(id_col).eqNullSafe(F.col(i)) & (F.col(x) == F.col(gx)) & (F.col(y) == F.col(gy)), "left")
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(g)), lambda p: F.get(lines, p))
    return both.withColumns({
        "_n_lines": F.size(lines).cast("long"),
        "_n_dropped": F.coalesce(F.size(g), F.lit(0)).cast("long"),
        text_col: F.when(F.col(g).isNull(), text_of(text_col)).otherwise(F.array_join(stay, "\n")),
    }).drop(x, y, i, gx, gy, g)
