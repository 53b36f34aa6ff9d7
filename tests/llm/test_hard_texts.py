"""Texts that are hard on one operator or another: runs of blanks, crafted words, number signs, repeats."""

import hashlib
import math
import random
import time
import zlib

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

from statloom.llm import bpe_chunks, decontamination, language, minhash, token_files
from statloom.llm.vocabulary import default_path
from statloom.session import work_path
from tests.llm.conftest import prose

BLANKS = [(1, " " * 1_100_000), (2, "a\n" + "\n" * 1_050_000 + "b"), (3, "short")]


@pytest.fixture(scope="module")
def wanted():
    library = Tokenizer.from_file(default_path())
    return {k: library.encode(t, add_special_tokens=False).ids for k, t in BLANKS}


def test_chunks_of_a_million_blanks(spark, wanted):
    for r in bpe_chunks.encode(spark.createDataFrame(BLANKS, "doc_id long, text string"), default_path()).collect():
        ids = wanted[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_token_files_of_a_million_blanks(spark, wanted):
    path = work_path(spark)
    token_files.write_token_files(spark.createDataFrame(BLANKS, "doc_id long, text string"), path, default_path())
    for r in token_files.read_token_files(spark, path, with_ids=False).collect():
        ids = np.array([*wanted[r["doc_id"]], 0], "<u4")
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))


def test_crafted_words_stay_apart(spark):
    """Words that are equal under any polynomial hash modulo a power of two."""
    for bits in (10, 11):
        parity = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << bits))
        other = parity.translate(str.maketrans("ab", "ba"))
        rows = [(1, parity), (2, other), (3, parity), (4, "x y z u " + parity), (5, "x y z u " + other)]
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id", "kept").collect()
        assert sorted(map(tuple, got)) == [(1, 1, True), (2, 2, True), (3, 1, False), (4, 4, True), (5, 5, True)]


def test_shingle_hashes_count_the_shingles():
    rng = random.Random(1)
    for text in [None, "", " \t\n", "One two", "A b c d e", "É é É é É é é", *[" ".join(rng.choice("abC") for _ in range(n)) for n in (4, 5, 6, 30, 300)]]:
        first, second = minhash.shingle_hashes(text)
        assert len(first) == len(second) == len(minhash.shingle_set(text)) and first.tolist() == sorted(first.tolist())


def test_number_signs_are_no_letters(spark):
    model = {"de": b"der die und", "en": b"the and of"}
    rows = [(1, "½ ² ①"), (2, "12 ½ der die und"), (3, "٣ ⅷ"), (4, "___")]
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert found == {1: "und", 2: "de", 3: "und", 4: "und"}


def test_language_against_a_plain_loop(spark):
    rng = random.Random(2)
    model = {n: prose(random.Random(i), 300).encode() for i, n in enumerate("cab")}
    rows = [(i, prose(rng, rng.randint(1, 40)) if i % 5 else (model["a"].decode() * 6)[10 * i : 10 * i + 9000]) for i in range(40)]
    got = {r["doc_id"]: r for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for key, text in rows:
        sizes = {}
        for name, data in model.items():
            setting = zstandard.ZstdCompressionParameters.from_level(5, dict_size=len(data), source_size=4096, min_match=3, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_dict_id=False)
            own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw = language.letters(text).encode()
            # a new compressor for every block
            sizes[name] = sum(len(zstandard.ZstdCompressor(dict_data=own, compression_params=setting).compress(raw[i : i + 4096])) for i in range(0, len(raw), 4096))
        best = min(sizes, key=lambda n: (sizes[n], n))
        margin = (sorted(sizes.values())[1] - sizes[best]) / sizes[best]
        score = 1 / sum(math.exp((sizes[best] - s) / (0.02 * sizes[best])) for s in sizes.values())
        row = got[key]
        assert row["lang_pred"] == best and row["accepted"] == (margin >= 0.02)
        assert row["score"] == pytest.approx(score) and row["margin"] == pytest.approx(margin)


def test_an_item_repeated_ten_thousand_times():
    item = prose(random.Random(3), 12)
    items, automaton = decontamination.search([item], 0.1)
    begun = time.perf_counter()
    found = list(decontamination.matches(" ".join([item] * 10_000), items, automaton))
    assert len({(a, b) for _, a, b, _ in found}) == len(found) == 10_000 and time.perf_counter() - begun < 20
