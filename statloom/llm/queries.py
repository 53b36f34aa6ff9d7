"""The registered queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import alignment, bpe_chunks, decontamination, language, main_text, minhash, ngram_quality, pii_crf, preference, quality_rules, spelling, token_files, toxicity
from statloom.llm.vocabulary import default_path
from statloom.plans.registry import Tables
from statloom.session import cut_lineage, work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under a name."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_quality_rules")
def _(t):
    """Statistics and verdict of every document."""
    docs = t("documents").select("doc_id", "text")
    judged = quality_rules.judge(docs, quality_rules.learn_rules(docs, t("labels")))
    return judged.select("doc_id", *(F.col("_stats")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")


@query("op2_personal_data")
def _(t):
    """Spans of personal data in every document."""
    docs = t("documents").select("doc_id", "text")
    return pii_crf.find(docs, pii_crf.learn(docs))


@query("op3_bpe")
def _(t):
    """All documents encoded by shared chunks, and decoded."""
    return bpe_chunks.encode(t("documents"), default_path())


NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS u, doc_id AS v FROM g UNION SELECT r.u, p.v FROM r JOIN p ON r.v = p.u),
c AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM g JOIN c USING (doc_id)"""


@query("op4_near_duplicates", NEAR_SQL)
def _(t):
    """All documents with their component of near copies."""
    return minhash.near_duplicates(t("documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query("op5_language")
def _(t):
    """Learned from the documents whose CRC-32 mod 4 is not 2, predicted for all."""
    docs = t("documents")
    out = language.held_out(F.col("doc_id"), 4, 2)
    dictionaries = language.learn(docs.filter(~F.coalesce(out, F.lit(False)) & F.col("doc_id").isNotNull()))
    found = language.predict(docs, dictionaries)
    return found.select("doc_id", language.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "margin", "accepted")


@query("op6_quality_classifier")
def _(t):
    """Perplexity of every document under a model of the documents labelled good."""
    found = ngram_quality.classify(t("documents"), t("labels").filter("quality = 1"))
    return found.select("doc_id", "n_chars", "perplexity", "limit", "kept")


PAIR_SQL = """
WITH t AS (SELECT conv_id AS conv, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT *, max(CASE WHEN role = 'assistant' THEN pos END) OVER (PARTITION BY conv) AS reply, max(pos) OVER (PARTITION BY conv) AS last FROM t),
b AS (SELECT k.*, o.text AS other, o.conv IS NOT NULL AND k.reply IS NOT NULL AS swaps FROM k LEFT JOIN (SELECT * FROM k WHERE pos = reply) o ON o.conv = k.conv + 1),
s AS (SELECT conv, 'chosen' AS side, pos, role, text FROM b UNION ALL
  SELECT conv, 'rejected', pos, role, CASE WHEN swaps AND pos = reply THEN other ELSE text END FROM b WHERE swaps OR pos <> last),
d AS (SELECT conv, min(pos) AS diff FROM (SELECT conv, pos FROM s GROUP BY conv, pos HAVING count(*) <> 2 OR min((coalesce(role, ''), coalesce(text, ''))) <> max((coalesce(role, ''), coalesce(text, '')))) GROUP BY conv),
r AS (SELECT s.*, pos < coalesce(diff, 2147483647) AS prompt, '<|' || replace(coalesce(role, 'unknown'), '|>', '') || '|>' || chr(10) AS head, replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS said FROM s LEFT JOIN d USING (conv)),
p AS (SELECT *, head || said AS drawn, coalesce(sum(length(head || said)) OVER (PARTITION BY conv, side, prompt ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM r)
SELECT conv AS pair_id, count(*) FILTER (WHERE prompt AND side = 'chosen') AS n_prompt_turns,
  coalesce(string_agg(drawn, '' ORDER BY pos) FILTER (WHERE prompt AND side = 'chosen'), '') AS prompt,
  coalesce(string_agg(drawn, '' ORDER BY pos) FILTER (WHERE NOT prompt AND side = 'chosen'), '') AS chosen,
  coalesce(string_agg(drawn, '' ORDER BY pos) FILTER (WHERE NOT prompt AND side = 'rejected'), '') AS rejected,
  coalesce(string_agg((start + length(head)) || ':' || (start + length(drawn)), ',' ORDER BY pos) FILTER (WHERE NOT prompt AND side = 'chosen' AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((start + length(head)) || ':' || (start + length(drawn)), ',' ORDER BY pos) FILTER (WHERE NOT prompt AND side = 'rejected' AND role = 'assistant'), '') AS rejected_mask
FROM p GROUP BY conv"""


@query("op7_preference_pairs", PAIR_SQL)
def _(t):
    """Every conversation against itself with the last reply of the next one."""
    found = preference.format_pairs(preference.swapped_replies(t("conversations")))
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias(c)
    return found.select("pair_id", "n_prompt_turns", "prompt", "chosen", "rejected", listed("chosen_mask"), listed("rejected_mask"))


@query("op8_token_files")
def _(t):
    """All documents written as token files in the shared folder, and what the files hold."""
    path = work_path(t.spark)
    token_files.write_token_files(t("documents"), path, default_path())
    read = cut_lineage(token_files.read_token_files(t.spark, path, with_ids=False).drop("ids"))
    return token_files.with_starts(read).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op9_toxicity")
def _(t):
    """Learned from the labels of documents whose CRC-32 mod 5 is not 0, scored for all."""
    docs, out = t("documents"), language.held_out(F.col("doc_id"), 5, 0)
    model = toxicity.learn(docs, t("labels").filter(~out))
    found = toxicity.score(docs, model)
    return found.select("doc_id", out.alias("held_out"), "score", "predicted", "evidence", "similarity")


@query("op10_decontamination")
def _(t):
    """Every document with the benchmark items found in it."""
    marked = decontamination.mark_documents(t("documents").select("doc_id", "text"), t("benchmark"))
    return marked.select("doc_id", (~F.col("contaminated")).alias("kept"), "contaminated", "n_items", "items")


@query("op11_alignment")
def _(t):
    """All documents aligned between two tokenizers, with the corpus counts of their links."""
    return alignment.link_statistics(t("documents"), default_path(), alignment.default_pieces())


@query("op12_main_text")
def _(t):
    """The main text of all pages."""
    return main_text.extract(t("pages"))


SPELLING_SQL = r"""
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, _b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END)) AS t),
d AS (SELECT coalesce(doc_id::VARCHAR, '') AS k, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
u AS (SELECT k, run, count(*) AS m, hex(encode(k || ':' || run)) AS x FROM d GROUP BY k, run),
c AS (SELECT run, m, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295::BIGINT) AS h FROM u, bits),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, m FROM c),
v AS (SELECT word, sum(m)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(m) >= 3),
g AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM v, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
p AS (SELECT DISTINCT a.word AS word, b.word AS near, b.n AS near_n FROM g a JOIN g b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, v.word, v.n FROM g JOIN v ON g.rest = v.word UNION SELECT v.word, g.word, g.n FROM g JOIN v ON g.rest = v.word),
b AS (SELECT word, count(*) AS n_near, max(near_n) AS top, arg_min(near, (-near_n, near)) AS near FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 2 * n THEN near END AS form, CASE WHEN top >= 2 * n THEN top END AS form_n FROM v LEFT JOIN b USING (word)),
r AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON r.next = f.word)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n::BIGINT AS form_n FROM f JOIN r ON f.word = r.word AND r.next IS NULL"""


@query("op13_spelling", SPELLING_SQL)
def _(t):
    """All words of the documents with their near words, forms and roots."""
    return spelling.group_variants(spelling.words(t("documents"), misspell=97))
