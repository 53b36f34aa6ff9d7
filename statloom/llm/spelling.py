"""Spelling variants: words one edit apart, joined by asymmetric chunks.

Of two words at most one edit apart the shorter one (of equals: either) is cut into two
disjoint chunks. One edit leaves one of them whole, and the longer word holds it as one of
its positional grams, shifted by at most one place. Common beginnings and endings would
make such a join quadratic, so the other half, which holds the edit, is cut into two chunks
once more, and the join key is the whole half with the whole chunk of the other. Joined
pairs are verified.

Tables with a row or more per word are joined by sorting (``merge``): Spark sizes them by
their compressed files and without the rows an explode adds, and would send them to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.session import cut_lineage

# Letters of a word, and the capitals that are lowered.
LETTERS = r"[A-Za-zÀ-ÿ]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A form has at least twice the uses of its word, so a chain of forms has at most 62 steps.
ROUNDS = 6


def words(docs: DataFrame, shortest: int = 5, least: int = 3, misspell: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, n): different words of at least ``shortest`` code points used ``least`` times or more.

    Words are maximal runs of letters, A-Z lowered. With ``misspell``, a word of a row whose
    CRC-32 of ``<key>:<word>`` is divisible by it loses the code point at the checksum modulo
    its length; a null key counts as an empty one. Null and empty texts have no words,
    repeated rows count each, further columns are not looked at. Every task adds up its own
    uses before anything is shuffled.
    """
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(F.translate(text, CAPITALS, CAPITALS.lower()), F.lit(LETTERS), F.lit(0))).alias("run"))
    word = F.col("run")
    if misspell:
        size = F.length("run")
        crc = F.crc32(F.concat_ws(":", "k", "run").cast("binary"))
        at = F.pmod(crc, size).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + F.lit(2), size))
        word = F.when(F.pmod(crc, F.lit(misspell)) == 0, cut).otherwise(word)
    used = runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return used.filter((F.length("word") >= shortest) & (F.col("n") >= least))


def near_pairs(listed: DataFrame) -> DataFrame:
    """(word, n, near, near_n): both directions of all pairs of words exactly one edit apart.

    ``listed`` holds different words of at least four code points, as ``words`` gives them.
    An edit inserts, deletes or replaces one code point.
    """
    chunks = _inline(listed, _chunks(F.col("word"))).toDF("x", "x_n", "key")
    grams = _inline(listed, _grams(F.col("word"))).toDF("y", "y_n", "key")
    joined = chunks.join(grams.hint("merge"), "key").filter((F.length("y") > F.length("x")) | (F.col("x") < F.col("y")))
    found = joined.filter(_one_edit(F.col("x"), F.col("y"))).select("x", "x_n", "y", "y_n").distinct()
    one, other = (F.struct(*(F.col(c).alias(a) for c, a in zip(side, ("word", "n", "near", "near_n")))) for side in (("x", "x_n", "y", "y_n"), ("y", "y_n", "x", "x_n")))
    return found.select(F.inline(F.array(one, other)))


def _inline(listed: DataFrame, keys: list[Column]) -> DataFrame:
    return listed.select("word", "n", F.explode(F.array(*keys)).alias("key"))


def _part(word: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end``, counted from 0."""
    return F.substring(word, start + F.lit(1), end - start)


def _cut(a: Column, b: Column) -> Column:
    """Where the places ``a`` to ``b`` are cut into two chunks."""
    return F.shiftright(a + b, 1)


def _chunks(word: Column) -> list[Column]:
    """The four keys of a word whose chunks are whole in the other one."""
    size = F.length(word)
    return _keys(word, size, F.lit(0))


def _grams(word: Column) -> list[Column]:
    """The keys of a word that may be met by an equally long word, or by one shorter by one.

    Of all positional grams only those can join within shift one that have the length of a
    chunk of the other word and stand at its place, or one further; only they are given.
    """
    size = F.length(word)
    return [*_keys(word, size, F.lit(0)), *_keys(word, size - F.lit(1), F.lit(1))]


def _keys(word: Column, size: Column, shift: Column) -> list[Column]:
    """Keys of the chunks of a word of ``size``, read from ``word``, where what stands behind the edit is moved by ``shift``."""
    half, end = _cut(F.lit(0), size), size
    first, second = _cut(F.lit(0), half), _cut(half, end)
    places = [  # the whole half, and the whole chunk of the half with the edit
        ("a", (F.lit(0), half, F.lit(0)), (half, second, F.lit(0))),
        ("b", (F.lit(0), half, F.lit(0)), (second, end, shift)),
        ("c", (half, end, shift), (F.lit(0), first, F.lit(0))),
        ("d", (half, end, shift), (first, half, shift)),
    ]
    out = []
    for name, (a, b, moved), (c, d, also) in places:
        out.append(F.xxhash64(F.lit(name), size, _part(word, a + moved, b + moved), _part(word, c + also, d + also)))
    return out


def _one_edit(x: Column, y: Column) -> Column:
    """Whether two words are exactly one edit apart."""
    return F.levenshtein(x, y, 1) == 1


def group_variants(listed: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word with its near words, form and root.

    The form of a word is the near word with most uses (ties: the smallest in code-point
    order) if it has at least ``ratio`` times the uses of the word, else null. The root is
    the end of the chain of forms, the word itself if it has no form. An empty table gives
    no row. ``ratio`` is at least 2, which bounds the chains.
    """
    if ratio < 2:
        raise ValueError("a form needs at least twice the uses of its word")
    listed = cut_lineage(listed)
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))
    near = near_pairs(listed).groupBy(F.col("word").alias("of")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = listed.join(near.hint("merge"), F.col("word") == F.col("of"), "left").drop("of")
    enough = -F.col("best.m") >= ratio * F.col("n")
    formed = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n"))
    formed = cut_lineage(formed)
    # words with a form, each with a word further along its chain; doubled until nothing moves
    chains = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(ROUNDS):
        ahead = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut_lineage(chains.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        chains = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
    ends = chains.withColumnRenamed("word", "of")
    return formed.join(ends.hint("merge"), F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
