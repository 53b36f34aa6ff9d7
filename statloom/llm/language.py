"""Language by compression: the dictionary that shortens a text most names its language.

``learn`` keeps a bounded sample of text per language as a raw zstandard dictionary;
``predict`` compresses every whole text with every dictionary, block by block, and takes
the smallest total.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.arrow import map_rows

UNDETERMINED = "und"

_NO_LETTER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-case words only: case, digits and signs say little about the language."""
    return _NO_LETTER.sub(" ", text.lower()).strip()


def learn(train: DataFrame, text: str = "text", lang: str = "lang", excerpts: int = 192, excerpt_chars: int = 1200) -> dict[str, bytes]:
    """Raw dictionaries per language from at most ``excerpts`` × ``excerpt_chars`` characters each.

    Texts are dealt into ``excerpts`` slots by a hash of the text, and each slot keeps the
    text with the smallest hash, so the sample does not depend on order or partitioning and
    the result is bounded whatever the size of the table. Rows without text or language are
    left out; without any row left there is no dictionary. Copies of a text count once.
    """
    # the hash picks the texts, so equal texts meet in one slot
    rows = train.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    keyed = rows.select(
        "lang", F.pmod(F.xxhash64("text"), F.lit(excerpts)).alias("slot"), F.xxhash64("text", F.lit(1)).alias("h"), F.substring("text", 1, excerpt_chars).alias("excerpt")
    )
    kept = keyed.groupBy("lang", "slot").agg(F.min(F.struct("h", "excerpt")).alias("m")).select("lang", "slot", "m.excerpt").collect()
    parts: dict[str, list[tuple[int, str]]] = {}
    for row in kept:
        parts.setdefault(row["lang"], []).append((row["slot"], row["excerpt"]))
    return {name: "\n".join(letters(x) for _, x in sorted(parts[name])).encode() for name in sorted(parts)}


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", key: str = "doc_id", block_bytes: int = 4096, level: int = 5, min_margin: float = 0.02) -> DataFrame:
    """(key, lang_pred, score, margin, accepted) for every row of ``docs``.

    The compressed sizes of a text's blocks are added up per language. ``margin`` is how
    much larger the second smallest total is, as a share of the smallest; ``score`` turns
    the totals into a share between 0 and 1; ``accepted`` is false where the margin is
    below ``min_margin``. Blocks keep a long text from teaching the compressor its own
    language. A NULL text, a text without letters, and an empty model give ``und`` with
    score 0 and not accepted. Ties go to the first name in order. Repeated keys give one
    row each.
    """
    names = sorted(dictionaries)
    held = docs.sparkSession.sparkContext.broadcast([dictionaries[n] for n in names])

    def run(columns):
        import math

        import zstandard

        compressors = []
        for data in held.value:
            prepared = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            # three-byte matches let short texts tell languages apart
            setting = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(data), source_size=block_bytes, min_match=3, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_dict_id=False)
            prepared.precompute_compress(compression_params=setting)
            compressors.append(zstandard.ZstdCompressor(dict_data=prepared, compression_params=setting))
        for doc, value in zip(columns["k"], columns["t"]):
            plain = letters(value or "")
            if not names or not any(map(str.isalpha, plain)):
                yield doc, UNDETERMINED, 0.0, 0.0, False
                continue
            raw = memoryview(plain.encode())
            blocks = [raw[i : i + block_bytes] for i in range(0, len(raw), block_bytes)]
            sizes = [sum(len(c.compress(b)) for b in blocks) for c in compressors]
            order = sorted(range(len(names)), key=lambda i: (sizes[i], i))
            best = sizes[order[0]]
            margin = (sizes[order[1]] - best) / best if len(order) > 1 else 1.0
            score = 1 / sum(math.exp((best - s) / (0.02 * best)) for s in sizes)
            yield doc, names[order[0]], score, margin, margin >= min_margin

    kind = dict(docs.dtypes)[key]
    return map_rows(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"`{key}` {kind}, lang_pred string, score double, margin double, accepted boolean")


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether the CRC-32 of the key's decimal text falls in ``part`` of ``parts``."""
    return F.crc32(key.cast("string").cast("binary")) % parts == part
