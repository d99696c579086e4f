"""Queries over the driver's tables, one or more for each operator, and the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.keyed import key_of, sql_key, sql_uniform
from palimpsest.functions.text import canon, contains_answer, text_of, tokens
from palimpsest.operators import bm25, hybrid, kv, metrics, models, noise, ranking
from palimpsest.plans import cli, degradation
from palimpsest.sources import corpus, fixtures
from palimpsest.sources.shared import written
from palimpsest.streaming import rows as stream_rows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def sixth(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def lead(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# SQL building blocks
S_CANON = "regexp_replace(translate({}, 'oli|sz', '011152'), '[\\s\\x0B\\x1c-\\x1f\\x85\\p{{Z}}]+', ' ', 'g')"


def sql_canon(x: str) -> str:
    x = f"lower(replace(replace(coalesce({x}, ''), '-' || chr(10), ''), chr(10), ' '))"
    for a, b in (("rn", "m"), ("cl", "d"), ("vv", "w"), ("nn", "m")):
        x = f"replace({x}, '{a}', '{b}')"
    return S_CANON.format(x)


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+(?:\\.[0-9]+)?')"


S_QUESTIONS = """gold AS (SELECT item_id AS qid, b.text, min(doc_id) AS gold_chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY ALL),
questions AS (SELECT qid, array_to_string(string_split(text, ' ')[1:12], ' ') AS question, array_to_string(string_split(text, ' ')[13:15], ' ') AS answer, gold_chunk_id FROM gold)"""


def s_index(name: str, canonical: bool = False) -> str:
    of = (lambda x: sql_tokens(sql_canon(x))) if canonical else sql_tokens
    return f"""{name}_t AS (SELECT doc_id AS id, {of("text")} AS t FROM documents),
{name}_size AS (SELECT count(*) AS n, CASE WHEN avg(len(t)) > 0 THEN avg(len(t)) ELSE 1e0 END AS avgdl FROM {name}_t),
{name}_p AS (SELECT id, len(t) AS dl, term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM {name}_t) GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df, ln(1e0 + (n - count(*) + 0.5e0) / (count(*) + 0.5e0)) AS idf FROM {name}_p, {name}_size GROUP BY term, n),
{name}_w AS (SELECT id, term, tf, tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl)) * idf AS w FROM {name}_p JOIN {name}_df USING (term), {name}_size)"""


def s_bm25(name: str, canonical: bool = False) -> str:
    of = (lambda x: sql_tokens(sql_canon(x))) if canonical else sql_tokens
    return f"""{s_index(name, canonical)},
{name}_q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({of("question")}) AS term FROM questions) GROUP BY ALL),
{name}_s AS (SELECT qid, id, sum(qtf * w) AS score FROM {name}_w JOIN {name}_q USING (term) GROUP BY ALL)"""


def s_full(name: str) -> str:
    return f"""{name}_r AS (SELECT qid, id, coalesce(score, 0e0) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(coalesce(score, 0e0), 9) DESC, id) AS rank
  FROM (SELECT qid, doc_id AS id FROM questions, documents) LEFT JOIN {name}_s USING (qid, id))"""


S_DENSE = "dense_s AS (SELECT q.qid, v.vec_id AS id, list_inner_product(v.embedding::DOUBLE[], w.embedding::DOUBLE[]) AS score FROM questions q JOIN embeddings w ON w.vec_id = q.qid, embeddings v WHERE v.vec_id IN (SELECT doc_id FROM documents))"
S_HYBRID = "hybrid_s AS (SELECT qid, id, sum(1e0 / (60 + rank)) AS score FROM (SELECT * FROM canon_r UNION ALL SELECT * FROM dense_r) GROUP BY ALL)"
S_TOP = "SELECT qid, id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM {}_s) WHERE rank <= 5"


def asked_of(spark, sf_dir) -> DataFrame:
    """The questions, made once."""
    return written(fixtures.questions(spark, sf_dir), "questions")


def question_vectors(spark, sf_dir, questions) -> DataFrame:
    """A synthetic pairing: vectors are unrelated to texts, so a question takes the vector with its number."""
    return questions.join(fixtures.vectors(spark, sf_dir), F.col("qid") == F.col("id")).select("qid", "embedding")


def both_lists(spark, sf_dir, questions) -> hybrid.Both:
    """Documents with what gives their scores in both lists that the hybrid fuses."""
    docs = fixtures.chunks(spark, sf_dir).select("id", "text")
    return hybrid.both(docs, questions, fixtures.vectors(spark, sf_dir), question_vectors(spark, sf_dir, questions))


def four_rankings(spark, sf_dir, questions, depth: int = 10) -> DataFrame:
    """The first `depth` of all four retrievers; every id has a place in a parent's list, so also in the hybrid's."""
    docs = fixtures.chunks(spark, sf_dir)
    plain = ranking.filled(bm25.scores(docs, questions, first=depth), docs.select("id"), questions.select("qid"), depth)
    plain = ranking.top_k(plain, depth).withColumn("retriever", F.lit("bm25"))
    return written(plain.unionByName(hybrid.first_of_all(both_lists(spark, sf_dir, questions), depth)), "rankings")


# text


@query("SELECT doc_id AS id, len(" + sql_tokens("text") + ")::BIGINT AS n_tokens, len(list_distinct(" + sql_tokens("text") + "))::BIGINT AS n_terms FROM documents")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixtures.chunks(spark, sf_dir).select("id", tokens("text").alias("t"))
    return docs.select("id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


@query("SELECT doc_id AS id, " + sql_canon("text") + " AS canon FROM documents")
def canon_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.chunks(spark, sf_dir).select("id", canon("text").alias("canon"))


@query(
    "WITH a AS (SELECT count(DISTINCT t) AS n FROM (SELECT unnest(" + sql_tokens("text") + ") AS t FROM documents)), b AS (SELECT count(DISTINCT t) AS n FROM (SELECT unnest(" + sql_tokens(sql_canon("text")) + ") AS t FROM documents)) "
    "SELECT a.n AS terms, b.n AS canonical_terms FROM a, b"
)
def canon_vocab_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixtures.chunks(spark, sf_dir)
    count = lambda c, name: docs.select(F.explode(tokens(c)).alias("t")).agg(F.countDistinct("t").alias(name))
    return count(F.col("text"), "terms").crossJoin(count(canon("text"), "canonical_terms"))  # one row each


@query(lead(S_QUESTIONS) + "SELECT qid, question, answer, gold_chunk_id FROM questions")
def questions_with_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.questions(spark, sf_dir)


# BM25


@query("SELECT count(*)::BIGINT AS n, round(CASE WHEN avg(len(t)) > 0 THEN avg(len(t)) ELSE 1e0 END, 6) AS avgdl FROM (SELECT " + sql_tokens("text") + " AS t FROM documents)")
def doc_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.corpus_size(bm25.tokenized(fixtures.chunks(spark, sf_dir))).select("n", *sixth("avgdl"))


@query(lead(s_index("plain")) + "SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM plain_df")
def term_df_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bm25.tokenized(fixtures.chunks(spark, sf_dir))
    return bm25.inverse_frequency(bm25.postings(rows), bm25.corpus_size(rows)).select("term", "df", *sixth("idf"))


@query(lead(s_index("plain")) + "SELECT id, term, tf::BIGINT AS tf, round(w, 6) AS w FROM plain_w")
def bm25_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bm25.tokenized(fixtures.chunks(spark, sf_dir))
    own = bm25.postings(rows)
    return bm25.weighted(own, bm25.inverse_frequency(own, bm25.corpus_size(rows))).select("id", "term", "tf", *sixth("w"))


@query(lead(S_QUESTIONS, s_bm25("plain")) + S_TOP.format("plain"))
def bm25_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_k(bm25.scores(fixtures.chunks(spark, sf_dir), asked_of(spark, sf_dir), False, first=5), 5).select("qid", "id", "rank", *sixth("score"))


@query(lead(S_QUESTIONS, s_bm25("canon", True)) + S_TOP.format("canon"))
def bm25_canon_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_k(bm25.scores(fixtures.chunks(spark, sf_dir), asked_of(spark, sf_dir), True, first=5), 5).select("qid", "id", "rank", *sixth("score"))


def s_recall(name: str) -> str:
    return f"""{name}_e AS (SELECT q.qid, coalesce(max(CASE WHEN id = gold_chunk_id AND rank <= 5 THEN 1e0 END), 0e0) AS r, coalesce(max(CASE WHEN id = gold_chunk_id AND rank <= 10 THEN 1e0 / rank END), 0e0) AS m
  FROM questions q LEFT JOIN {name}_r USING (qid) GROUP BY q.qid)"""


@query(lead(S_QUESTIONS, s_bm25("plain"), s_full("plain"), s_recall("plain")) + "SELECT round(avg(r), 6) AS recall_at_5, round(avg(m), 6) AS mrr_at_10 FROM plain_e")
def recall_mrr_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = asked_of(spark, sf_dir)
    top = ranking.top_k(bm25.scores(fixtures.chunks(spark, sf_dir), asked, first=10), 10)
    per = asked.join(top, "qid", "left").groupBy("qid").agg(metrics.recall_at(5).alias("r"), metrics.reciprocal_rank_at(10).alias("m"))
    return per.agg(F.round(F.avg("r"), 6).alias("recall_at_5"), F.round(F.avg("m"), 6).alias("mrr_at_10"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions, their five best documents and whether the gold one is among them."""
    asked = asked_of(spark, sf_dir)
    top = ranking.top_k(bm25.scores(fixtures.chunks(spark, sf_dir), asked, True, first=5), 5)
    return top.join(asked, "qid").select("qid", "question", "id", "rank", *sixth("score"), (F.col("id") == F.col("gold_chunk_id")).alias("is_gold"))


@query(
    "WITH t AS (SELECT doc_id AS id, " + sql_tokens("text") + " AS t FROM documents), p AS (SELECT id, term FROM (SELECT id, unnest(t) AS term FROM t) GROUP BY ALL) "
    "SELECT count(DISTINCT id)::BIGINT AS documents, count(DISTINCT term)::BIGINT AS terms, count(*)::BIGINT AS postings, round(count(DISTINCT id) * count(DISTINCT term) * 4 / 1e6, 6) AS dense_mb, round(count(*) * 20 / 1e6, 6) AS sparse_mb FROM p"
)
def index_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = bm25.index_size(bm25.postings(bm25.tokenized(fixtures.chunks(spark, sf_dir))))
    return size.select("documents", "terms", "postings", *sixth("dense_mb", "sparse_mb"))


# dense scores and fusion

S_PAIRS = "SELECT a.vec_id AS qid, b.vec_id AS id, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b"


def vector_queries(spark, sf_dir) -> DataFrame:
    return fixtures.vectors(spark, sf_dir).select(F.col("id").alias("qid"), "embedding")


@query("WITH dense_s AS (" + S_PAIRS + ") " + S_TOP.format("dense"))
def dense_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_k(ranking.dense_first(fixtures.vectors(spark, sf_dir), vector_queries(spark, sf_dir), 5), 5).select("qid", "id", "rank", *sixth("score"))


@query("SELECT qid, round(min(score), 6) AS least, round(max(score), 6) AS most, round(avg(score), 6) AS mean FROM (" + S_PAIRS + ") GROUP BY qid")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.dense_extremes(fixtures.vectors(spark, sf_dir), vector_queries(spark, sf_dir)).select("qid", *sixth("least", "most", "mean"))


@query("SELECT vec_id AS id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.vectors(spark, sf_dir).select("id", F.round(ranking.norm(F.col("embedding")), 6).alias("norm"))


S_BOTH = (S_QUESTIONS, s_bm25("canon", True), s_full("canon"), S_DENSE, s_full("dense"), S_HYBRID)


@query(lead(*S_BOTH) + "SELECT qid, id, round(score, 9) AS score FROM hybrid_s")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.fused_all(both_lists(spark, sf_dir, asked_of(spark, sf_dir))).select("qid", "id", F.round("score", 9).alias("score"))


@query(lead(*S_BOTH) + S_TOP.format("hybrid"))
def hybrid_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = hybrid.first_of_all(both_lists(spark, sf_dir, asked_of(spark, sf_dir)), 5)
    return first.where("retriever = 'hybrid'").select("qid", "id", "rank", *sixth("score"))


def s_answers(name: str) -> str:
    blob = "coalesce(string_agg(concat_ws(' ', coalesce(source, ''), coalesce(lang, ''), coalesce(text, '')), ' ' ORDER BY rank), '')"
    return f"""{name}_a AS (SELECT qid, contains(b, answer)::INT AS e, contains({sql_canon("b")}, {sql_canon("answer")})::INT AS c
  FROM (SELECT q.qid, answer, {blob} AS b FROM questions q LEFT JOIN (SELECT * FROM {name}_r WHERE rank <= 5) USING (qid) LEFT JOIN documents d ON d.doc_id = id GROUP BY q.qid, answer))"""


def s_eval(name: str, label: str) -> str:
    return f"SELECT '{label}' AS retriever, round(avg(r), 6) AS recall_at_5, round(avg(m), 6) AS mrr_at_10, round(avg(e), 6) AS ans_exact_at_5, round(avg(c), 6) AS ans_canon_at_5 FROM {name}_e JOIN {name}_a USING (qid)"


NAMES = {"plain": "bm25", "canon": "bm25-canon", "dense": "dense", "hybrid": "hybrid"}


@query(lead(*S_BOTH, s_bm25("plain"), s_full("plain"), s_full("hybrid"), *(f(n) for n in NAMES for f in (s_recall, s_answers))) + " UNION ALL ".join(s_eval(n, label) for n, label in NAMES.items()))
def eval_all_retrievers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = asked_of(spark, sf_dir)
    docs = fixtures.chunks(spark, sf_dir).withColumn("indexed", F.concat_ws(" ", text_of("doc_title"), text_of("section"), text_of("text")))
    told = metrics.evaluate(four_rankings(spark, sf_dir, asked), asked, docs)
    return told.select("retriever", *sixth("recall_at_5", "mrr_at_10", "ans_exact_at_5", "ans_canon_at_5"))


def answered(spark, sf_dir, canonical: bool) -> DataFrame:
    asked = asked_of(spark, sf_dir)
    top = ranking.top_k(bm25.scores(fixtures.chunks(spark, sf_dir), asked, canonical, first=5), 5)
    passages = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    found = fixtures.chunks(spark, sf_dir).select("id", "text").join(F.broadcast(top), "id")  # five rows a question
    return found.join(F.broadcast(asked), "qid").groupBy("qid", "answer").agg(passages.alias("passages"))


def s_found(name: str) -> str:
    return f"""top AS ({S_TOP.format(name)}), b AS (SELECT top.qid, answer, string_agg(text, ' ' ORDER BY rank) AS b FROM top JOIN documents ON doc_id = id JOIN questions ON questions.qid = top.qid GROUP BY ALL)"""


@query(lead(S_QUESTIONS, s_bm25("plain"), s_found("plain")) + "SELECT qid, contains(b, answer) AS found FROM b")
def answer_exact_at5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answered(spark, sf_dir, False).select("qid", contains_answer(F.col("passages"), "answer").alias("found"))


@query(lead(S_QUESTIONS, s_bm25("canon", True), s_found("canon")) + f"SELECT qid, contains({sql_canon('b')}, {sql_canon('answer')}) AS found FROM b")
def answer_canon_at5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answered(spark, sf_dir, True).select("qid", contains_answer(F.col("passages"), "answer", True).alias("found"))


# noise

RATES = ("ocr", "whitespace", "hyphenation", "header", "redaction")


def noisy(spark, sf_dir, family: str, rate: float) -> DataFrame:
    docs = fixtures.chunks(spark, sf_dir)
    return docs.select("id", noise.NOISE[family](text_of("text"), F.lit(rate), key_of(F.lit(7), F.col("id"), F.lit("text"), F.lit(family))).alias("noisy"))


def s_keyed(family: str) -> str:
    return "k AS (SELECT doc_id, coalesce(text, '') AS text, " + sql_key("7", "doc_id", "'text'", f"'{family}'") + " AS key FROM documents)"


@query(
    lead(s_keyed("whitespace")) + f"""SELECT doc_id AS id, array_to_string(list_transform(string_split(text, ''), lambda c, i: CASE
  WHEN {sql_uniform("key", "i - 1")} >= CASE WHEN c = ' ' THEN 0.055e0 ELSE 0.055e0 * 0.35e0 END THEN c WHEN c <> ' ' THEN c || ' '
  WHEN {sql_uniform("key", "i - 1", 1)} < 0.5e0 THEN '' ELSE '  ' END), '') AS noisy FROM k"""
)
def noise_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noisy(spark, sf_dir, "whitespace", 0.055)


@query(
    lead(s_keyed("hyphenation")) + f"""SELECT doc_id AS id, array_to_string(list_transform(string_split(text, ' '), lambda w, i: CASE
  WHEN length(w) >= 7 AND {sql_uniform("key", "i - 1")} < 0.05e0 * 6 THEN w[1:(3 + floor({sql_uniform("key", "i - 1", 1)} * (length(w) - 5)))::INT] || '-' || chr(10)
    || w[(4 + floor({sql_uniform("key", "i - 1", 1)} * (length(w) - 5)))::INT:] ELSE w END), ' ') AS noisy FROM k"""
)
def noise_hyphenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noisy(spark, sf_dir, "hyphenation", 0.05)


@query(
    lead(s_keyed("header"), "s AS (SELECT *, string_split(replace(text, '. ', '. ' || chr(1)), chr(1)) AS s FROM k)",
         f"h AS (SELECT *, floor({sql_uniform('key', '1', 4)} * (len(s) + 1))::INT AS pos, replace(replace(([{', '.join(repr(x) for x in noise.HEADERS)}])[(1 + floor({sql_uniform('key', '1', 1)} * {len(noise.HEADERS)}))::INT], "
         f"'{{p}}', (1 + floor({sql_uniform('key', '1', 2)} * 400))::INT::VARCHAR), '{{n}}', (1 + floor({sql_uniform('key', '1', 3)} * 900))::INT::VARCHAR) AS h FROM s)")
    + "SELECT doc_id AS id, array_to_string(list_concat(s[1:pos], [chr(10) || h || chr(10)], s[pos + 1:]), '') AS noisy FROM h"
)
def noise_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noisy(spark, sf_dir, "header", 1.0)


def s_map(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{a!r}: {b!r}" for a, b in pairs.items()) + "}"


@query(
    lead(
        s_keyed("ocr"),
        "c AS (SELECT doc_id, key, unnest(string_split(text, '')) AS ch, unnest(range(0, length(text))) AS i FROM k)",
        f"h AS (SELECT doc_id, i, ch, {sql_uniform('key', 'i')} < 0.19e0 AS hit, ch || coalesce(lead(ch) OVER (PARTITION BY doc_id ORDER BY i), '') AS pair FROM c)",
        f"w AS (SELECT *, hit AND pair IN ({', '.join(map(repr, noise.PAIRS))}) AS wide FROM h)",
        "g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, wide ORDER BY i) AS run FROM w)",
        "e AS (SELECT *, wide AND (row_number() OVER (PARTITION BY doc_id, wide, run ORDER BY i)) % 2 = 1 AS taken FROM g)",
        f"o AS (SELECT doc_id, i, CASE WHEN coalesce(lag(taken) OVER (PARTITION BY doc_id ORDER BY i), false) THEN '' WHEN taken THEN ({s_map(noise.PAIRS)})[pair] WHEN hit THEN coalesce(({s_map(noise.SINGLES)})[ch], ch) ELSE ch END AS out FROM e)",
    )
    + "SELECT k.doc_id AS id, coalesce(string_agg(out, '' ORDER BY i), '') AS noisy FROM k LEFT JOIN o USING (doc_id) GROUP BY k.doc_id"
)
def noise_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noisy(spark, sf_dir, "ocr", 0.19)


def s_greedy(hits: str) -> str:
    """The places of hits that no earlier one has used up. hits: a list of {t: the places it uses, d: the first behind}."""
    return f"list_reduce({hits}, lambda a, x: CASE WHEN x.t[1] >= a.d THEN {{'t': list_concat(a.t, x.t), 'd': x.d}} ELSE a END, {{'t': []::BIGINT[], 'd': 0::BIGINT}}).t"


def s_swallowed(rate: str, key: str) -> str:
    """The places of redacted words in `w`."""
    behind = f"i + 1 + floor({sql_uniform(key, 'i', 1)} * 4)::BIGINT"
    return s_greedy(f"list_transform(list_filter(range(0, len(w)), lambda i: {sql_uniform(key, 'i')} < {rate}), lambda i: {{'t': range(i, {behind}), 'd': {behind}}})")


S_REDACTED = "array_to_string(list_transform(list_filter(list_zip(w, range(0, len(w))), lambda p: NOT list_contains(taken, p[2])), lambda p: p[1]), ' ')"


@query(lead(s_keyed("redaction"), "w AS (SELECT *, string_split(text, ' ') AS w FROM k)", f"t AS MATERIALIZED (SELECT *, {s_swallowed('0.05e0', 'key')} AS taken FROM w)") + f"SELECT doc_id AS id, {S_REDACTED} AS noisy FROM t")
def noise_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noisy(spark, sf_dir, "redaction", 0.05)


S_LADDER = "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{label}', {', '.join(f'{float(spec.get(f, 0))!r}::DOUBLE' for f in RATES)})" for k, (label, spec) in enumerate(noise.CONDITIONS)) + f") t(ord, label, {', '.join(RATES)})"


def s_corrupted(source: str) -> str:
    """`damaged` (condition, id, doc_title, section, text): all conditions over `source`, a family at a time."""
    kept = f"condition, {', '.join(RATES)}, id, field, k_redaction, k_hyphenation, k_whitespace, k_ocr, k_header"
    keys = ", ".join(sql_key("7", "id", "field", f"'{f}'") + f" AS k_{f}" for f in noise.FAMILIES)
    fields = " UNION ALL ".join(f"SELECT id, '{f}' AS field, coalesce({f}, '') AS v FROM {source}" for f in ("doc_title", "section", "text"))
    cut = f"(3 + floor({sql_uniform('k_hyphenation', 'i - 1', 1)} * (length(x) - 5)))::INT"
    hits = f"list_transform(list_filter(range(0, len(w) - 1), lambda i: {sql_uniform('k_ocr', 'i')} < ocr AND (w[i + 1] || w[i + 2]) IN ({', '.join(map(repr, noise.PAIRS))})), lambda i: {{'t': [i], 'd': i + 2}})"
    step = lambda name, of, split, rate, value: f"{name}_w AS MATERIALIZED (SELECT {kept}, v, CASE WHEN {rate} > 0 THEN {split} END AS w FROM {of}),\n{name} AS MATERIALIZED (SELECT {kept}, CASE WHEN {rate} > 0 THEN {value} ELSE v END AS v FROM {name}_w)"
    words, letters = "string_split(v, ' ')", "string_split(v, '')"
    lines = f"([{', '.join(repr(x) for x in noise.HEADERS)}])"
    number = lambda j, draw, most: f"(1 + floor({sql_uniform('k_header', str(j), draw)} * {most}))::INT"
    line = lambda j: f"replace(replace({lines}[{number(j, 1, len(noise.HEADERS))}], '{{p}}', {number(j, 2, 400)}::VARCHAR), '{{n}}', {number(j, 3, 900)}::VARCHAR)"
    place = lambda j: f"floor({sql_uniform('k_header', str(j), 4)} * (len(w) + 1))::INT"
    inserted = [
        f"h{j} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN n >= {j} THEN list_concat(w[1:{place(j)}], [chr(10) || {line(j)} || chr(10)], w[{place(j)} + 1:]) ELSE w END AS w) FROM h{j - 1})"
        for j in range(1, 1 + int(max(spec.get("header", 0) for _, spec in noise.CONDITIONS)))
    ]
    return ",\n".join([
        f"ladder AS ({S_LADDER})", f"fields AS ({fields})",
        f"n0 AS MATERIALIZED (SELECT label AS condition, {', '.join(RATES)}, id, field, v, {keys} FROM fields, ladder)",
        f"n1_w AS MATERIALIZED (SELECT {kept}, v, CASE WHEN redaction > 0 THEN {words} END AS w FROM n0)",
        f"n1_t AS MATERIALIZED (SELECT *, {s_swallowed('redaction', 'k_redaction')} AS taken FROM n1_w)",
        f"n1 AS MATERIALIZED (SELECT {kept}, CASE WHEN redaction > 0 THEN {S_REDACTED} ELSE v END AS v FROM n1_t)",
        step("n2", "n1", words, "hyphenation", f"array_to_string(list_transform(w, lambda x, i: CASE WHEN length(x) >= 7 AND {sql_uniform('k_hyphenation', 'i - 1')} < hyphenation * 6 THEN x[1:{cut}] || '-' || chr(10) || x[{cut} + 1:] ELSE x END), ' ')"),
        step("n3", "n2", letters, "whitespace", f"array_to_string(list_transform(w, lambda c, i: CASE WHEN {sql_uniform('k_whitespace', 'i - 1')} >= CASE WHEN c = ' ' THEN whitespace ELSE whitespace * 0.35e0 END THEN c WHEN c <> ' ' THEN c || ' ' WHEN {sql_uniform('k_whitespace', 'i - 1', 1)} < 0.5e0 THEN '' ELSE '  ' END), '')"),
        f"n4_w AS MATERIALIZED (SELECT {kept}, v, CASE WHEN ocr > 0 THEN {letters} END AS w FROM n3)",
        f"n4_t AS MATERIALIZED (SELECT *, {s_greedy(hits)} AS taken FROM n4_w)",
        f"n4 AS MATERIALIZED (SELECT {kept}, CASE WHEN ocr > 0 THEN array_to_string(list_transform(w, lambda c, i: CASE WHEN list_contains(taken, i - 2) THEN '' WHEN {sql_uniform('k_ocr', 'i - 1')} >= ocr THEN c WHEN list_contains(taken, i - 1) THEN ({s_map(noise.PAIRS)})[c || w[i + 1]] ELSE coalesce(({s_map(noise.SINGLES)})[c], c) END), '') ELSE v END AS v FROM n4_t)",
        f"h0 AS MATERIALIZED (SELECT condition, id, field, k_header, v, string_split(replace(v, '. ', '. ' || chr(1)), chr(1)) AS w, CASE WHEN field = 'text' THEN floor(header)::INT + CASE WHEN {sql_uniform('k_header', '0')} < header - floor(header) THEN 1 ELSE 0 END ELSE 0 END AS n FROM n4)",
        *inserted,
        f"damaged AS (SELECT condition, id, max(CASE WHEN field = 'doc_title' THEN v END) AS doc_title, max(CASE WHEN field = 'section' THEN v END) AS section, max(CASE WHEN field = 'text' THEN v END) AS text FROM (SELECT condition, id, field, array_to_string(w, '') AS v FROM h{len(inserted)}) GROUP BY ALL)",
    ])


@query(S_LADDER)
def condition_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    ladder = noise.conditions(spark)
    return ladder.select("ord", "label", *[F.coalesce(F.col("spec")[f], F.lit(0.0)).alias(f) for f in RATES])


@query(lead("chunks AS (SELECT doc_id AS id, source AS doc_title, lang AS section, text FROM documents)", s_corrupted("chunks")) + "SELECT id, condition, length(x)::INT AS n_chars, md5(x) AS digest FROM (SELECT id, condition, concat_ws(' ', doc_title, section, text) AS x FROM damaged)")
def corrupt_all_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = noise.corrupt_all(fixtures.chunks(spark, sf_dir), noise.conditions(spark))
    return damaged.select("id", "condition", F.length("indexed").alias("n_chars"), F.md5("indexed").alias("digest"))


@query()
def cer_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over all documents, each compared whole."""
    return noise.ladder_error_rates(fixtures.chunks(spark, sf_dir), noise.conditions(spark)).select("condition", *sixth("cer"))


@query()
def degradation_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ladder and all retrievers over the generated corpus."""
    told = degradation.degradation(spark)
    return told.select("condition", "retriever", *sixth("cer", "recall_at_5", "mrr_at_10", "ans_exact_at_5", "ans_canon_at_5"))


@query()
def retriever_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.compare(degradation.degradation(spark), "bm25-canon", "hybrid")


# quantization

S_Q = """base AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, list_min(embedding::DOUBLE[]) AS lo, list_max(embedding::DOUBLE[]) AS hi FROM embeddings),
q AS (SELECT id, v, lo, CASE WHEN hi = lo THEN 1e-8 ELSE (hi - lo) / {levels} END AS scale FROM base),
c AS (SELECT *, list_transform(v, lambda x: least(greatest(round_even((x - lo) / scale, 0), 0), {levels})::BIGINT) AS codes FROM q)"""


@query(lead(S_Q.format(levels=255)) + "SELECT id, array_to_string(codes, ',') AS codes, round(scale, 9) AS scale, round(lo, 9) AS lo FROM c")
def kv_quantize_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = kv.quantized(fixtures.vectors(spark, sf_dir), 8, "embedding")
    return q.select("id", F.concat_ws(",", F.transform("q", lambda x: x.cast("string"))).alias("codes"), F.round("scale", 9).alias("scale"), F.round("lo", 9).alias("lo"))


@query(lead(S_Q.format(levels=15)) + "SELECT id, array_to_string(list_transform(range(1, len(codes) // 2 + 1), lambda i: codes[2 * i - 1] + 16 * codes[2 * i]), ',') AS packed FROM c")
def kv_pack_int4(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = kv.quantized(fixtures.vectors(spark, sf_dir), 4, "embedding")
    return q.select("id", F.concat_ws(",", F.transform(kv.packed(F.col("q")), lambda x: x.cast("string"))).alias("packed"))


def s_error(bits: int) -> str:
    levels = 2**bits - 1
    return f"""SELECT id, {bits} AS bits, round(list_max(list_transform(list_zip(v, codes), lambda p: abs(p[1] - (p[2] * scale + lo)))), 6) AS worst FROM (
  SELECT *, list_transform(v, lambda x: least(greatest(round_even((x - lo) / scale, 0), 0), {levels})::BIGINT) AS codes FROM (SELECT id, v, lo, CASE WHEN hi = lo THEN 1e-8 ELSE (hi - lo) / {levels} END AS scale FROM base))"""


@query(lead("base AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, list_min(embedding::DOUBLE[]) AS lo, list_max(embedding::DOUBLE[]) AS hi FROM embeddings)") + s_error(8) + " UNION ALL " + s_error(4) + " UNION ALL SELECT id, 32, 0e0 FROM base")
def kv_roundtrip_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.vectors(spark, sf_dir)

    def error(bits: int) -> DataFrame:
        back = kv.through(F.col("embedding"), bits)
        gap = F.array_max(F.zip_with("embedding", back, lambda a, b: F.abs(a.cast("double") - b)))
        return rows.select("id", F.lit(bits).alias("bits"), F.round(gap, 6).alias("worst"))

    return error(8).unionByName(error(4)).unionByName(error(32))


@query("SELECT * FROM (VALUES (32, 73728::BIGINT), (16, 36864::BIGINT), (8, 20736::BIGINT), (4, 11520::BIGINT)) t(bits, bytes_per_token)")
def kv_bytes_by_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.bytes_per_token(spark)


@query("SELECT bits, sum(64 * bits // 8 + CASE WHEN bits < 16 THEN 8 ELSE 0 END)::BIGINT AS bytes FROM embeddings, (VALUES (32), (16), (8), (4)) t(bits) GROUP BY bits")
def kv_cache_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.vectors(spark, sf_dir).select(F.size("embedding").alias("size")).crossJoin(F.broadcast(kv.bit_widths(spark)))  # four widths
    return rows.groupBy("bits").agg(F.sum(kv.stored_bytes(F.col("size"), F.col("bits"))).alias("bytes"))


@query("SELECT label::INT AS head, count(*)::BIGINT AS tokens, round(sum(embedding[1]::DOUBLE * rn), 6) AS checksum FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) GROUP BY label")
def kv_append_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as keys of one layer, the label as head: appended in two parts and read back in order of tokens."""
    cache = fixtures.vectors(spark, sf_dir).select(F.lit("k").alias("side"), F.lit(0).alias("layer"), F.col("label").alias("head"), F.col("id").alias("token"), F.col("embedding").alias("vec"))
    both = kv.appended(cache.where("token % 2 = 0"), cache.where("token % 2 = 1"))
    held = kv.sequences(both).select("head", F.size("vecs").cast("long").alias("tokens"), F.transform("vecs", lambda v, i: v[0].cast("double") * (i + 1)).alias("x"))
    return held.select("head", "tokens", F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 6).alias("checksum"))


@query("SELECT item_id, array_to_string(list_transform(range(0, 64), lambda i: t[(i % len(t)) + 1]), ' ') AS tiled FROM (SELECT item_id, " + sql_tokens("text") + " AS t FROM benchmark)")
def sequence_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(kv.tiled(tokens("text"), 64), " ").alias("tiled"))


@query()
def kv_sweep_toy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cli.kv_table(spark)


@query()
def encode_toy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.encoded(fixtures.table(spark, sf_dir, "benchmark"), "text", models.toy_encoder())
    return rows.select("item_id", F.size("embedding").alias("width"), F.round(ranking.norm(F.col("embedding")), 5).alias("norm"))


# statistics


@query(
    "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) "
    "SELECT event_type, round(median(value), 6) AS p50, round(max(CASE WHEN i = n * 95 // 100 + 1 THEN value END), 6) AS p95 FROM r GROUP BY event_type"
)
def latency_p50_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency(fixtures.table(spark, sf_dir, "events"), "value", ("event_type",)).select("event_type", *sixth("p50", "p95"))


# generated corpus and streams


def s_corpus() -> str:
    """`generated`: chunks and questions of the corpus with the default seed."""
    names = lambda rows: f"([{', '.join(repr(x) for x in rows)}])"
    pick = lambda rows, at: f"{names(rows)}[(({at}) % {len(rows)} + 1)::INT]"
    between = lambda k, low, high: f"({low} + floor({sql_uniform('key', str(k))} * {high - low + 1}))::BIGINT"
    money = lambda k, low, high, step: f"'$' || format('{{:,}}', {between(k, low // step, high // step)} * {step})"
    values = {
        "amount": money(0, 2_000_000, 90_000_000, 500_000), "fee": money(1, 10_000, 400_000, 2_500), "rate": money(2, 250, 950, 25), "retainer": money(3, 5_000, 60_000, 1_000),
        "margin": f"printf('%.2f', {between(4, 100, 525)} / 100e0)", "ratio": f"printf('%.1f', {between(5, 20, 65)} / 10e0)", "month": pick(corpus.MONTHS, between(6, 0, 5)),
        "year": between(7, 2026, 2034) + "::VARCHAR", "days": between(8, 2, 15) + "::VARCHAR", "account": f"printf('%04d-%d', {between(9, 1000, 9999)}, {between(10, 0, 9)})",
        "file": f"printf('F%05d', {between(11, 10000, 99999)})", "weeks": between(12, 3, 26) + "::VARCHAR",
    }
    held = ("borrower", "agent", "firm", "partner", *values)
    n, quoted = len(corpus.BORROWERS), lambda x: "'" + x.replace("'", "''") + "'"

    def fill(x: str) -> str:
        for name in held:
            x = f"replace({x}, '{{{name}}}', {name})"
        return x

    rows = ", ".join(f"('{f}', {k}, {', '.join(map(quoted, t))})" for f, group in (("credit", corpus.CREDIT), ("legal", corpus.LEGAL)) for k, t in enumerate(group))
    return f"""d AS (SELECT 'credit' AS family, i AS ord, printf('AG-%03d', i) AS doc_id, {pick(corpus.BORROWERS, "i")} AS borrower, {pick(corpus.AGENTS, "i")} AS agent, '' AS firm, '' AS partner, 'Credit agreement' AS kind FROM range({n}) t(i)
  UNION ALL SELECT 'legal', i + {n}, printf('LT-%03d', i), {pick(corpus.BORROWERS, "i // 2 * 2 + i % 2")}, '', {pick(corpus.FIRMS, "i // 2")}, {pick(corpus.PARTNERS, "i // 2 * 2 + i % 2")}, 'Engagement letter' FROM range({2 * len(corpus.FIRMS)}) t(i)),
drawn AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in values.items())} FROM (SELECT *, {sql_key("1729", "doc_id")} AS key FROM d)),
templates AS (SELECT * FROM (VALUES {rows}) t(family, place, section, body, ask, told)),
generated AS (SELECT CASE WHEN family = 'credit' THEN ord * {len(corpus.CREDIT)} + place ELSE {n * len(corpus.CREDIT)} + (ord - {n}) * {len(corpus.LEGAL)} + place END::BIGINT AS id,
  doc_id, kind || ' ' || doc_id AS doc_title, section, {fill("body")} AS text, {fill("ask")} AS question, {fill("told")} AS answer, family FROM drawn JOIN templates USING (family))"""


@query(lead(s_corpus()) + "SELECT id, doc_id, doc_title, section, text FROM generated")
def corpus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunks(spark)


@query(lead(s_corpus(), s_corrupted("generated")) + "SELECT condition, round(avg(levenshtein(g.text, d.text) / length(g.text)::DOUBLE), 6) AS cer FROM damaged d JOIN generated g USING (id) GROUP BY condition")
def corpus_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates of the generated corpus, which is ASCII, as distances in SQL are between bytes."""
    return noise.ladder_error_rates(corpus.chunks(spark), noise.conditions(spark)).select("condition", *sixth("cer"))


@query(lead(s_corpus()) + "SELECT id AS qid, question, answer, id AS gold_chunk_id, family FROM generated")
def corpus_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.questions(spark)


@query("SELECT doc_id AS id, len(" + sql_tokens(sql_canon("text")) + ")::BIGINT AS n_tokens FROM documents")
def stream_canonical_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as a stream, in one run over what is there."""
    schema = fixtures.table(spark, sf_dir, "documents").schema
    rows = stream_rows.canonical_tokens(stream_rows.read_parquet(spark, f"{sf_dir}/documents.parquet*", schema)).select(F.col("doc_id").alias("id"), F.size("tokens").cast("long").alias("n_tokens"))
    return stream_rows.run_once(rows, "canonical_tokens")
