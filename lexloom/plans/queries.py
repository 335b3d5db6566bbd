"""Registered queries over the driver's tables, and the DuckDB SQL that checks them."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from lexloom.functions import lexicon as L
from lexloom.functions import text as T
from lexloom.functions.kernels import matcher_ratio, phonetic_similarity, weighted_edit_distance
from lexloom.operators import adjudicate, canon, classify, dedup, evaluate, normalize, retrieve, vocab
from lexloom.plans.joins import small
from lexloom.plans.staging import shared_dir, staged
from lexloom.sources import text_tables
from lexloom.streaming import vocab_stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: sizes of the stand-in lexicons: exact words, dictionary forms, common words
N_ENGLISH, N_LEMMAS, N_COMMON = 1500, 4000, 3000
ASCII = "^[a-z]+$"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")


def _vocab(spark, sf_dir, name="documents"):
    return vocab.document_frequency(read(spark, sf_dir, name))


def _english(spark, sf_dir, n=N_ENGLISH):
    return text_tables.top_lexicon(vocab.document_frequency(_docs(spark, sf_dir).filter("lang = 'en'")), n)


def _routed(spark, sf_dir):
    return classify.route(_vocab(spark, sf_dir), _english(spark, sf_dir))


def _labelled(spark, sf_dir):
    return classify.classify(_vocab(spark, sf_dir), _english(spark, sf_dir))


def _cascade(spark, sf_dir, words=None):
    """Labels by all rules. _labelled stops before the fuzzy rule, as the SQL of its queries does."""
    lexicons = [_english(spark, sf_dir, n) for n in (N_ENGLISH, N_LEMMAS, N_COMMON)]
    return classify.classify(_vocab(spark, sf_dir) if words is None else words, *lexicons)


def _freq_sql(source: str, where: str = "text IS NOT NULL") -> str:
    return f"(SELECT token, count(*)::BIGINT AS freq FROM (SELECT unnest(list_distinct({T.tokens_sql('text')})) AS token FROM {source} WHERE {where}) GROUP BY token)"


_LEX = lambda n: f"(SELECT token AS word FROM {_freq_sql('documents', chr(39).join(['text IS NOT NULL AND lang = ', 'en', '']))} ORDER BY freq DESC, token LIMIT {n})"
_NUMBER_LIKE = r"(regexp_matches(token, '^\p{Nd}+$') OR (regexp_matches(token, '\p{Nd}') AND regexp_matches(token, '[a-zA-Z]')))"
_ROUTED = f"""(SELECT token, freq, CASE WHEN {_NUMBER_LIKE} THEN 'NUMERIC_OR_ALPHANUMERIC' WHEN word IS NOT NULL THEN 'ENGLISH' ELSE 'CANDIDATE_HINGLISH' END AS category
  FROM {_freq_sql("documents")} v LEFT JOIN {_LEX(N_ENGLISH)} e ON lower(token) = word)"""
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_ODD = f"(NOT regexp_matches(token, '{T.SANE}') OR regexp_matches(token, '{T.NO_LETTER}') OR regexp_matches(token, '{T.NUMBER_UNIT}'))"
_LABELLED = f"""(SELECT token, freq,
  CASE WHEN {_ODD} THEN 'NON_LINGUISTIC' WHEN token IN {_IN(L.AMBIGUOUS_OVERRIDE)} THEN 'AMBIGUOUS' WHEN token IN {_IN(L.HINGLISH_OVERRIDE)} THEN 'HINGLISH'
    WHEN word IS NOT NULL THEN 'ENGLISH' ELSE 'UNCERTAIN_NEEDS_LLM' END AS label,
  CASE WHEN {_ODD} THEN 'regex_prefilter' WHEN token IN {_IN(L.AMBIGUOUS_OVERRIDE)} THEN 'override_ambiguous' WHEN token IN {_IN(L.HINGLISH_OVERRIDE)} THEN 'override_hinglish'
    WHEN word IS NOT NULL THEN 'wordnet_exact' ELSE 'unresolved' END AS method
  FROM {_freq_sql("documents")} v LEFT JOIN {_LEX(N_ENGLISH)} e ON lower(token) = word)"""
_COVER = lambda src: f"(SELECT *, row_number() OVER (ORDER BY freq DESC, token) AS rank, (sum(freq) OVER (ORDER BY freq DESC, token ROWS UNBOUNDED PRECEDING))::BIGINT AS running, (sum(freq) OVER ())::BIGINT AS total FROM {src})"


def _distance_sql(pairs: str, unit: bool = False) -> str:
    """a, b, distance of a SELECT of distinct a, b: the table of the weighted distance (or, with unit, of plain edits), one row of it at each step."""
    cost = lambda x: f"CASE WHEN {x} IN {_IN(L.VOWELS)} THEN {L.VOWEL_COST}::DOUBLE ELSE {L.OTHER_COST}::DOUBLE END"
    close = lambda x, y: " OR ".join(f"({x} = '{p}' AND {y} = '{q}') OR ({x} = '{q}' AND {y} = '{p}')" for p, q in L.CLOSE_PAIRS)
    swap = lambda x, y: f"CASE WHEN {x} = {y} THEN 0::DOUBLE WHEN {close(x, y)} THEN {L.CLOSE_COST}::DOUBLE WHEN {x} IN {_IN(L.VOWELS)} AND {y} IN {_IN(L.VOWELS)} THEN {L.VOWEL_COST}::DOUBLE ELSE {L.OTHER_COST}::DOUBLE END"
    if unit:
        cost, swap = (lambda x: "1::DOUBLE"), (lambda x, y: f"CASE WHEN {x} = {y} THEN 0::DOUBLE ELSE 1::DOUBLE END")
    return f"""(WITH RECURSIVE p AS ({pairs}),
t(a, b, i, r) AS (SELECT a, b, 0, list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc, acc[j] + {cost("b[j]")}), [0::DOUBLE]) FROM p
UNION ALL SELECT a, b, i + 1, list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc, least(least(r[j + 1] + del, acc[j] + {cost("b[j]")}), r[j] + {swap("x", "b[j]")})), [r[1] + del])
  FROM (SELECT *, a[i + 1] AS x, {cost("a[i + 1]")} AS del FROM t WHERE i < length(a)))
SELECT a, b, r[length(b) + 1] AS distance FROM t WHERE i = length(a))"""


_NEAR_LIMIT = "CASE WHEN length(w) <= 9 THEN 1 ELSE 2 END"


def _fuzzy_sql(words: str) -> str:
    """word: those of a SELECT of distinct w that have MIN_FUZZY letters and are a lemma or near a common one.

    Bytes differ in at most four places for each character that does, so byte distance narrows the pairs.
    """
    pairs = f"""SELECT w AS a, l AS b FROM (SELECT w, {_NEAR_LIMIT} AS k FROM ({words}) WHERE length(w) >= {classify.MIN_FUZZY}),
  (SELECT x.word AS l FROM {_LEX(N_LEMMAS)} x JOIN {_LEX(N_COMMON)} y ON x.word = y.word) WHERE left(w, 1) = left(l, 1) AND abs(length(w) - length(l)) <= k AND levenshtein(w, l) <= 4 * k"""
    return f"""(SELECT DISTINCT a AS word FROM {_distance_sql(pairs, unit=True)} WHERE distance <= {_NEAR_LIMIT.replace("(w)", "(a)")}
  UNION SELECT w FROM ({words}) JOIN {_LEX(N_LEMMAS)} ON w = word WHERE length(w) >= {classify.MIN_FUZZY})"""


_CASCADE = f"""(SELECT token, freq, CASE WHEN word IS NULL THEN label ELSE 'ENGLISH' END AS label, CASE WHEN word IS NULL THEN method ELSE 'wordnet_fuzzy_edit' || {_NEAR_LIMIT.replace("(w)", "(token)")} END AS method
  FROM {_LABELLED} LEFT JOIN {_fuzzy_sql(f"SELECT DISTINCT lower(token) AS w FROM {_LABELLED} WHERE label = 'UNCERTAIN_NEEDS_LLM'")} ON label = 'UNCERTAIN_NEEDS_LLM' AND lower(token) = word)"""


@query(f"SELECT 'documents' AS kind, doc_id AS id, md5({T.clean_sql('text')}) AS digest, length({T.clean_sql('text')})::BIGINT AS n_chars FROM documents UNION ALL SELECT 'html', page_id, md5({T.clean_sql('html')}), length({T.clean_sql('html')})::BIGINT FROM pages UNION ALL SELECT 'url', page_id, md5({T.clean_sql('url')}), length({T.clean_sql('url')})::BIGINT FROM pages")
def q01_clean_text(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    rows = _docs(spark, sf_dir).select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), F.col("text"))
    rows = rows.unionByName(pages.select(F.lit("html").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text")))
    rows = rows.unionByName(pages.select(F.lit("url").alias("kind"), F.col("page_id").alias("id"), F.col("url").alias("text")))
    c = T.clean(F.col("text"))
    return rows.select("kind", "id", F.md5(c).alias("digest"), F.length(c).cast("long").alias("n_chars"))


@query(f"SELECT conv_id, turn, sentence, translation FROM (SELECT conv_id, turn, role, text AS sentence, lead(role) OVER w AS r, lead(text) OVER w AS translation FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant' AND regexp_replace(sentence, '[{T.SPACE}]+', '', 'g') <> '' AND regexp_replace(translation, '[{T.SPACE}]+', '', 'g') <> ''")
def q02_usable_pairs(spark, sf_dir):
    return dedup.usable(text_tables.neighbours(read(spark, sf_dir, "conversations")), "sentence", "translation")


@query(f"SELECT kind, count(*)::BIGINT AS n, count(*) FILTER (len({T.tokens_sql('text')}) < 4)::BIGINT AS n_short FROM (SELECT 'documents' AS kind, text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark UNION ALL SELECT 'conversations', text FROM conversations) GROUP BY kind")
def q03_short_texts(spark, sf_dir):
    rows = [read(spark, sf_dir, n).select(F.lit(n).alias("kind"), dedup.short_flag(None, "text").alias("short")) for n in ("documents", "benchmark", "conversations")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("short").alias("n_short"))


@query(f"SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY md5({T.clean_sql('text')}) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def q04_keep_first(spark, sf_dir):
    return dedup.keep_first(_docs(spark, sf_dir)).select("doc_id", "lang", "source")


@query(f"SELECT token, freq FROM {_freq_sql('documents')}")
def q05_vocabulary(spark, sf_dir):
    return _vocab(spark, sf_dir)


@query(f"SELECT count(*)::BIGINT AS n_tokens, sum(freq)::BIGINT AS mass FROM {_freq_sql('documents')}")
def q06_vocabulary_totals(spark, sf_dir):
    return vocab.totals(_vocab(spark, sf_dir))


@query(f"SELECT token, freq FROM {_freq_sql('documents')} ORDER BY freq DESC, token LIMIT 100")
def q07_top_tokens(spark, sf_dir):
    return vocab.top(_vocab(spark, sf_dir), 100)


@query(f"SELECT token, freq, category FROM {_ROUTED}")
def q08_router(spark, sf_dir):
    return _routed(spark, sf_dir)


@query(f"SELECT token, freq, label, method FROM {_LABELLED}")
def q09_rules_cascade(spark, sf_dir):
    return _labelled(spark, sf_dir)


@query(f"""WITH v AS (SELECT token AS w FROM {_freq_sql("documents")} WHERE regexp_matches(token, '{ASCII}') AND length(token) >= {classify.MIN_FUZZY}),
l AS (SELECT a.word AS l FROM {_LEX(N_LEMMAS)} a JOIN {_LEX(N_COMMON)} b ON a.word = b.word WHERE regexp_matches(a.word, '{ASCII}'))
SELECT DISTINCT w AS word FROM v, l WHERE w[1] = l[1] AND abs(length(w) - length(l)) <= CASE WHEN length(w) <= 9 THEN 1 ELSE 2 END
AND levenshtein(w, l) <= CASE WHEN length(w) <= 9 THEN 1 ELSE 2 END""")
def q10_fuzzy_english(spark, sf_dir):
    plain = lambda df, c: df.filter(F.col(c).rlike(ASCII))
    return classify.fuzzy_matches(plain(_vocab(spark, sf_dir), "token"), plain(_english(spark, sf_dir, N_LEMMAS), "word"), _english(spark, sf_dir, N_COMMON))


_VOCAB = _freq_sql("documents")


@query(f"SELECT word FROM {_fuzzy_sql(f'SELECT DISTINCT lower(token) AS w FROM {_VOCAB}')}")
def q10b_fuzzy_any_script(spark, sf_dir):
    """As q10 over tokens of every script, and with exact hits on lemmas that are not common; a test compares it with brute force."""
    return classify.fuzzy_matches(_vocab(spark, sf_dir), _english(spark, sf_dir, N_LEMMAS), _english(spark, sf_dir, N_COMMON), exact=True)


@query(f"""WITH c AS (SELECT label, count(*) AS n FROM {_LABELLED} GROUP BY label), e AS (SELECT unnest(['{"', '".join(L.LABELS)}']) AS label)
SELECT e.label, coalesce(n, 0)::BIGINT AS n, round(100 * coalesce(n, 0) / sum(n) OVER (), 4) AS percent FROM e LEFT JOIN c ON e.label = c.label""")
def q11_label_histogram(spark, sf_dir):
    return vocab.histogram(_labelled(spark, sf_dir), "label", L.LABELS)


@query(f"SELECT label, method, count(*)::BIGINT AS n_tokens, sum(freq)::BIGINT AS mass, " + ", ".join(f"count(*) FILTER (freq >= {b})::BIGINT AS at_least_{b}" for b in (1, 5, 10, 50)) + f" FROM {_LABELLED} GROUP BY label, method")
def q12_label_mass(spark, sf_dir):
    return vocab.label_mass(_labelled(spark, sf_dir))


_CATEGORIES = ["NUMERIC_OR_ALPHANUMERIC", "ENGLISH", "CANDIDATE_HINGLISH"]


@query("SELECT least(length(token), 8)::INT AS bucket, " + ", ".join(f"count(*) FILTER (category = '{c}')::BIGINT AS {c.lower()}" for c in _CATEGORIES) + f", count(*)::BIGINT AS total, round(100.0::DOUBLE * count(*) FILTER (category = 'ENGLISH') / count(*), 4) AS share FROM {_ROUTED} GROUP BY bucket")
def q13_length_crosstab(spark, sf_dir):
    return vocab.crosstab(_routed(spark, sf_dir), "category", _CATEGORIES, "ENGLISH")


_SHORT = f"(SELECT token, freq FROM {_ROUTED} WHERE category = 'ENGLISH' AND length(token) <= 4)"


def _collisions(spark, sf_dir):
    return vocab.coverage(_routed(spark, sf_dir).filter((F.length("token") <= 4) & (F.col("category") == "ENGLISH")).select("token", "freq"))


@query(f"SELECT token, length(token)::INT AS length, freq, rank, running FROM {_COVER(_SHORT)}")
def q14_collision_pool(spark, sf_dir):
    return _collisions(spark, sf_dir).select("token", F.length("token").alias("length"), "freq", "rank", "running")


@query(" UNION ALL ".join(f"SELECT {s}::DOUBLE AS share, min(rank) AS n_tokens FROM {_COVER(_SHORT)} WHERE running >= {s}::DOUBLE * total" for s in (0.8, 0.95)))
def q14b_collision_coverage(spark, sf_dir):
    return vocab.rank_at_share(_collisions(spark, sf_dir), [0.8, 0.95])


_UNSURE = f"(SELECT token, freq FROM {_LABELLED} WHERE label = 'UNCERTAIN_NEEDS_LLM')"


def _pilot(spark, sf_dir):
    return vocab.pilot_pool(vocab.coverage(_labelled(spark, sf_dir).filter("label = 'UNCERTAIN_NEEDS_LLM'").select("token", "freq")))


_PILOT = f"""(WITH c AS (SELECT *, round(running / total * 100, 3) AS cum_pct FROM {_COVER(_UNSURE)}),
n AS (SELECT count(*) FILTER (cum_pct < 70) + 1 AS n70, count(*) FILTER (cum_pct < 80) + 1 AS n80 FROM c)
SELECT token, freq, cum_pct FROM c, n WHERE rank <= CASE WHEN n80 <= 2500 THEN n80 ELSE n70 END)"""


@query(f"SELECT * FROM {_PILOT}")
def q15_pilot_pool(spark, sf_dir):
    return _pilot(spark, sf_dir)


@query(f"WITH a AS {_freq_sql('documents')}, b AS {_freq_sql('benchmark')} (SELECT token FROM a EXCEPT SELECT token FROM b) UNION ALL (SELECT token FROM b EXCEPT SELECT token FROM a)")
def q16_unmatched_tokens(spark, sf_dir):
    return vocab.unmatched(_vocab(spark, sf_dir), _vocab(spark, sf_dir, "benchmark"))


@query(f"""WITH t AS (SELECT doc_id, unnest(list_distinct({T.tokens_sql("text")})) AS token FROM documents),
r AS (SELECT token, doc_id, row_number() OVER (PARTITION BY token ORDER BY doc_id) AS k FROM t WHERE token IN (SELECT token FROM {_freq_sql("benchmark")}))
SELECT token, min(doc_id) AS first, list(doc_id ORDER BY doc_id) FILTER (k <= 3) AS ids FROM r WHERE k <= 3 GROUP BY token""")
def q17_examples(spark, sf_dir):
    return vocab.examples(_docs(spark, sf_dir), _vocab(spark, sf_dir, "benchmark"))


@query(f"SELECT token, freq FROM {_freq_sql('documents')} ORDER BY md5('42' || token), token LIMIT 60")
def q18_seeded_sample(spark, sf_dir):
    return vocab.sample(_vocab(spark, sf_dir), 60)


@query()
def q19_near_pairs(spark, sf_dir):
    return dedup.near_pairs(dedup.keep_first(_docs(spark, sf_dir)))


@query()
def q20_near_groups(spark, sf_dir):
    docs = dedup.keep_first(_docs(spark, sf_dir))
    return dedup.near_groups(docs, pairs=staged(dedup.near_pairs(docs), "near-pairs"))


_LIT_OVERRIDE = _IN(L.HINGLISH_OVERRIDE)


@query(f"""WITH p AS {_freq_sql("benchmark")}, v AS {_freq_sql("documents")}, o AS (SELECT unnest(['{"', '".join(L.HINGLISH_OVERRIDE)}']) AS token)
SELECT coalesce(p.token, o.token) AS token, greatest(coalesce(p.freq, 0), coalesce(CASE WHEN o.token IS NOT NULL THEN v.freq END, 0))::BIGINT AS freq,
CASE WHEN o.token IS NOT NULL AND p.token IS NOT NULL THEN 'both' WHEN o.token IS NOT NULL THEN 'override_list' ELSE 'pilot_pool' END AS source
FROM p FULL JOIN o ON p.token = o.token LEFT JOIN v ON v.token = o.token""")
def q21_merge_pool(spark, sf_dir):
    override = spark.createDataFrame([(t,) for t in L.HINGLISH_OVERRIDE], "token string")
    return canon.merge_pool(_vocab(spark, sf_dir, "benchmark"), override, _vocab(spark, sf_dir))


@query(f"WITH a AS {_freq_sql('documents')}, d AS {_freq_sql('conversations')} SELECT token, freq FROM a WHERE token NOT IN (SELECT token FROM d WHERE NOT regexp_matches(token, '[0-9]'))")
def q22_pending_tokens(spark, sf_dir):
    reason = F.when(F.col("token").rlike("[0-9]"), "llm_call_failed_default:timeout").otherwise("clear")
    return adjudicate.pending(_vocab(spark, sf_dir), _vocab(spark, sf_dir, "conversations").withColumn("reason", reason))


_RESPONSES = [
    ("acha", 9, ["acha hai"], '{"label": "HINGLISH", "reason": "Hindi word"}', None),
    ("phone", 8, ["phone do"], 'Sure:\n```json\n{"label": "english", "reason": "loan"}\n```', None),
    ("main", 7, ["main hun", "main road"], 'I think {"label": "AMBIGUOUS", "reason": "both"} fits', None),
    ("yaar", 6, ["yaar sun"], '{"reason": "HINGLISH slang"}', None),
    ("koi", 5, ["koi hai"], '{"label": "hinglish"}', None),
    ("zzz", 4, ["zzz"], "no idea", "unparseable"),
    ("xyz", 3, ["xyz"], None, "rate-limit"),
    ("abc", 2, [], None, None),
]


@query("""SELECT * FROM (VALUES ('acha', 9::BIGINT, 'HINGLISH', 'Hindi word'), ('phone', 8, 'ENGLISH', 'loan'), ('main', 7, 'PENDING_MANUAL_REVIEW', 'both'),
('yaar', 6, 'HINGLISH', 'HINGLISH slang'), ('koi', 5, 'HINGLISH', 'ambiguous-unsure-default'), ('zzz', 4, 'HINGLISH', 'llm_call_failed_default:unparseable'),
('xyz', 3, 'HINGLISH', 'llm_call_failed_default:rate-limit'), ('abc', 2, 'HINGLISH', 'no_context_default')) t(token, freq, label, reason)""")
def q23_decisions(spark, sf_dir):
    return adjudicate.decide(spark.createDataFrame(_RESPONSES, "token string, freq long, examples array<string>, response string, error string"))


@query(f"""WITH v AS (SELECT token, [token, '', token || '0', reverse(token), token || '1', token || '2'] AS c, list_filter([token, '', token || '0', reverse(token), token || '1', token || '2'], lambda x: x <> '') AS f FROM {_freq_sql("benchmark")})
SELECT token, f[1] AS candidate_1, f[2] AS candidate_2, f[3] AS candidate_3, f[4] AS candidate_4, c[1:4] AS chunk FROM v""")
def q24_candidate_columns(spark, sf_dir):
    t = F.col("token")
    c = F.array(t, F.lit(""), F.concat(t, F.lit("0")), F.reverse(t), F.concat(t, F.lit("1")), F.concat(t, F.lit("2")))
    return _vocab(spark, sf_dir, "benchmark").select("token", *canon.padded(c), F.get(canon.chunks(c), F.lit(0)).alias("chunk"))


@query("SELECT 4::BIGINT AS n, true AS complete, true AS deterministic, 1::BIGINT AS mismatches, false AS trusted")
def q25_batch_gate(spark, sf_dir):
    rows = [(0, ["a", "b"], ["a", "c"], ["a"]), (1, ["x"], ["x"], ["y"]), (2, [], [], []), (3, ["q"], ["q"], ["q", "r"])]
    return canon.batch_gate(spark.createDataFrame(rows, "pos int, first_run array<string>, second_run array<string>, single array<string>"))


@query(f"SELECT token, reverse(token) AS form FROM {_freq_sql('documents')} WHERE length(token) > 2 AND token NOT IN {_IN(L.AMBIGUOUS_OVERRIDE)}")
def q26_canonical_map(spark, sf_dir):
    pool = _vocab(spark, sf_dir).withColumn("candidate_1", F.when(F.length("token") > 2, F.reverse("token")).otherwise(""))
    return canon.canonical_map(pool, spark.createDataFrame([(t,) for t in L.AMBIGUOUS_OVERRIDE], "token string"))


@query()
def q27_variant_clusters(spark, sf_dir):
    return canon.clusters(staged(_vocab(spark, sf_dir), "variants"))


_KEYS = "unnest([" + ", ".join(f"'{k}'" for k, _ in L.CANONICAL_MAP) + "])"


@query(f"""SELECT a AS token, b AS key, round(distance, 6) AS distance, round(greatest(0, 1 - distance / greatest(length(a), length(b))), 6) AS similarity
FROM {_distance_sql(f"SELECT token AS a, {_KEYS} AS b FROM {_freq_sql('benchmark')}")}""")
def q28_weighted_distance(spark, sf_dir):
    keys = F.array(*[F.lit(k) for k, _ in L.CANONICAL_MAP])
    pairs = _vocab(spark, sf_dir, "benchmark").select("token", F.explode(keys).alias("key"))
    t, k = F.col("token"), F.col("key")
    return pairs.select(t, k, F.round(weighted_edit_distance(t, k), 6).alias("distance"), F.round(phonetic_similarity(t, k), 6).alias("similarity"))


_MAP_SQL = "(SELECT unnest([" + ", ".join(f"'{k}'" for k, _ in L.CANONICAL_MAP) + "]) AS k, unnest([" + ", ".join(f"'{v}'" for _, v in L.CANONICAL_MAP) + f"]) AS v, unnest(range({len(L.CANONICAL_MAP)})) AS n)"
_MISSES = f"SELECT DISTINCT low AS a, {_KEYS} AS b FROM f WHERE plain <> '' AND hit IS NULL"


@query(f"""WITH q AS (SELECT 'demo-' || (n - 1) AS qid, query FROM (SELECT unnest({list(L.DEMO_QUERIES)}) AS query, unnest(range(1, {len(L.DEMO_QUERIES) + 1})) AS n)
  UNION ALL SELECT 'b-' || item_id, text FROM benchmark UNION ALL SELECT 'd-' || doc_id, text FROM documents),
w AS (SELECT qid, list_filter(regexp_split_to_array(coalesce(query, ''), '[{T.SPACE}]+'), lambda x: x <> '') AS ws FROM q),
t AS (SELECT qid, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos FROM w),
f AS (SELECT token, plain, lower(plain) AS low, v AS hit FROM (SELECT DISTINCT token, regexp_replace(token, '[^{T.WORD}{T.SPACE}]', '', 'g') AS plain FROM t) LEFT JOIN {_MAP_SQL} m ON plain <> '' AND lower(plain) = k),
s AS (SELECT a, b, 1 - distance / greatest(length(a), length(b)) AS similarity FROM {_distance_sql(_MISSES)}),
n AS (SELECT a, v, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, n) AS k FROM s JOIN {_MAP_SQL} m ON b = k WHERE similarity >= 0.75),
z AS (SELECT f.token, CASE WHEN plain = '' THEN 0 WHEN hit IS NOT NULL THEN 1 WHEN n.v IS NOT NULL THEN 2 ELSE 3 END AS tier,
  CASE WHEN plain = '' THEN token WHEN hit IS NOT NULL THEN hit WHEN n.v IS NOT NULL THEN n.v ELSE plain END AS form FROM f LEFT JOIN n ON low = a AND k = 1 AND plain <> '' AND hit IS NULL),
g AS (SELECT qid, string_agg(form, ' ' ORDER BY pos) AS said, {", ".join(f"count(*) FILTER (tier = {i}) AS t{i}" for i in range(4))} FROM t JOIN z ON t.token = z.token GROUP BY qid)
SELECT q.qid, md5(coalesce(said, '')) AS digest, {", ".join(f"coalesce(t{i}, 0)::INT AS n_tier_{i}" for i in range(4))} FROM q LEFT JOIN g ON q.qid = g.qid""")
def q29_normalize_queries(spark, sf_dir):
    demo = spark.createDataFrame([(f"demo-{i}", q) for i, q in enumerate(L.DEMO_QUERIES)], "qid string, query string")
    bench = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("b-"), F.col("item_id").cast("string")).alias("qid"), F.col("text").alias("query"))
    docs = _docs(spark, sf_dir).select(F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("qid"), F.col("text").alias("query"))
    out = normalize.normalize_queries(demo.unionByName(bench).unionByName(docs))
    at_tier = lambda name: F.filter("trace", lambda s: s["tier"] == name)
    tiers = [F.size(at_tier(t)).alias(f"n_tier_{i}") for i, t in enumerate(normalize.TIERS)]
    return out.select("qid", F.md5("normalized").alias("digest"), *tiers)




@query(f"""WITH d AS (SELECT unnest(['{"', '".join(L.DEMO_QUERIES)}']) AS query UNION ALL SELECT text FROM benchmark), t AS (SELECT DISTINCT unnest(regexp_split_to_array(query, '[{T.SPACE}]+')) AS token FROM d)
SELECT token, v AS form FROM t JOIN {_MAP_SQL} m ON lower(regexp_replace(token, '[^{T.WORD}{T.SPACE}]', '', 'g')) = k WHERE token <> ''""")
def q29b_exact_tier(spark, sf_dir):
    demo = spark.createDataFrame([(q,) for q in L.DEMO_QUERIES], "query string").unionByName(read(spark, sf_dir, "benchmark").select(F.col("text").alias("query")))
    tokens = demo.select(F.explode(F.array_remove(F.split("query", f"[{T.SPACE}]+"), "")).alias("token"))
    return normalize.normalize_tokens(tokens).filter(F.col("tier") == normalize.TIERS[1]).select("token", "form")


def _asked(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _bm25_sql(asked: str, docs: str) -> str:
    """asked: SELECT of qid, text; docs: SELECT of doc_id, text."""
    return f"""(WITH q AS (SELECT qid, unnest(list_distinct({T.tokens_sql("text")})) AS term FROM ({asked})),
b AS (SELECT doc_id, {T.tokens_sql("text")} AS ts FROM ({docs})), s AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM b),
h AS (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM b),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM h WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, doc_id, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len)) AS w FROM tf JOIN df USING (term), s),
r AS (SELECT qid, doc_id, round(sum(w), 6) AS score FROM w JOIN q USING (term) GROUP BY qid, doc_id)
SELECT qid, doc_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10)"""


_BM25 = _bm25_sql("SELECT item_id AS qid, text FROM benchmark", "SELECT doc_id, text FROM documents")


@query(f"SELECT * FROM {_BM25}")
def q30_bm25(spark, sf_dir):
    return retrieve.bm25(_asked(spark, sf_dir), _docs(spark, sf_dir))


_KNN = """(WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT qid, doc_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM p) WHERE rank <= 10)"""


def _neighbours(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return retrieve.nearest(vectors.filter("vec_id % 100 = 0"), vectors)


@query(f"SELECT * FROM {_KNN}")
def q31_nearest_vectors(spark, sf_dir):
    return _neighbours(spark, sf_dir)


_QRELS = "(SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(f"SELECT * FROM {_QRELS}")
def q32_relevance(spark, sf_dir):
    return retrieve.containing(_asked(spark, sf_dir), _docs(spark, sf_dir))


@query(f"""WITH f AS (SELECT q.qid, min(rank) AS best FROM (SELECT DISTINCT qid FROM {_QRELS}) q LEFT JOIN (SELECT r.* FROM {_BM25} r JOIN {_QRELS} g USING (qid, doc_id)) h ON h.qid = q.qid GROUP BY q.qid)
SELECT count(*)::BIGINT AS n_queries, round(avg(coalesce(1 / best, 0)), 6) AS mrr, """ + ", ".join(f"round(avg(CASE WHEN best <= {k} THEN 1 ELSE 0 END), 6) AS hit_{k}" for k in (1, 3, 5)) + " FROM f")
def q32b_hit_metrics(spark, sf_dir):
    asked, docs = _asked(spark, sf_dir), _docs(spark, sf_dir)
    return retrieve.hit_metrics(retrieve.bm25(asked, docs), staged(retrieve.containing(asked, docs), "relevant"))


@query(f"""WITH g AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND a.label = b.label),
n AS (SELECT qid, count(*) AS n_rel FROM g GROUP BY qid),
r AS (SELECT k.qid, rank, CASE WHEN g.doc_id IS NULL THEN 0 ELSE 1 END AS rel FROM {_KNN} k LEFT JOIN g ON g.qid = k.qid AND g.doc_id = k.doc_id),
f AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY rank) AS found FROM r),
p AS (SELECT qid, sum(rel * found / rank) AS ap, sum(rel / log2(rank + 1)) AS dcg FROM f GROUP BY qid),
i AS (SELECT qid, n_rel, (SELECT sum(1 / log2(x + 1)) FROM range(1, 11) t(x) WHERE x <= n_rel) AS ideal FROM n)
SELECT count(*)::BIGINT AS n_queries, round(avg(coalesce(ap, 0) / least(n_rel, 10)), 6) AS map, round(avg(coalesce(dcg, 0) / ideal), 6) AS ndcg FROM i LEFT JOIN p USING (qid)""")
def q33_graded_metrics(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    q = v.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), "label")
    return retrieve.graded_by_label(_neighbours(spark, sf_dir), v, q)


@query("SELECT event_type, n, round(mean, 6) AS mean, longest, round(max(mean) OVER () / mean, 6) AS speed_up FROM (SELECT event_type, count(value)::BIGINT AS n, avg(value) AS mean, max(value) AS longest FROM events GROUP BY event_type)")
def q34_latency(spark, sf_dir):
    out = retrieve.latency(read(spark, sf_dir, "events"), "event_type", "value")
    return out.withColumns({"mean": F.round("mean", 6), "speed_up": F.round("speed_up", 6)})


@query("SELECT 16::BIGINT AS correct, 1::BIGINT AS deferred, 0::BIGINT AS wrong, 94.1176::DOUBLE AS accuracy")
def q35_self_test(spark, sf_dir):
    want = [(t, "HINGLISH") for t in L.KNOWN_HINGLISH] + [(t, "ENGLISH") for t in L.KNOWN_ENGLISH]
    expected = spark.createDataFrame(want, "token string, want string")
    english = spark.createDataFrame([(t,) for t in L.KNOWN_ENGLISH if t != "wong"], "word string")
    return classify.self_test(classify.classify(expected.select("token"), english), expected)


@query("WITH p AS (SELECT p_type AS w, p_brand AS g FROM part), d AS (SELECT levenshtein(w, g) AS distance, w = g AS e, length(w) AS n FROM p) SELECT distance::INT AS distance, count(*)::BIGINT AS n, round(100 * avg(CASE WHEN e THEN 1 ELSE 0 END), 6) AS exact_pct, round(100 * avg(distance / greatest(n, 1)), 6) AS cer_pct FROM d GROUP BY distance")
def q36_error_histogram(spark, sf_dir):
    return evaluate.histogram(read(spark, sf_dir, "part").select(F.col("p_type").alias("want"), F.col("p_brand").alias("got")))


_NOISE = {
    1: "lower(text)",
    2: r"regexp_replace(lower(text), '([^aeiou\P{L}])[aeiou]+', '\1', 'g')",
    3: r"regexp_replace(regexp_replace(translate(lower(text), 'vz', 'wj'), 'ai', 'e', 'g'), 'a( |$)', 'aa\1', 'g')",
}


@query(" UNION ALL ".join(f"SELECT item_id, {k}::INT AS level, {e} AS noisy FROM benchmark" for k, e in _NOISE.items()))
def q37_noise_levels(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    rows = [b.select("item_id", F.lit(k).alias("level"), T.noise(F.col("text"), k).alias("noisy")) for k in _NOISE]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"""WITH r AS (SELECT * FROM {_BM25}), g AS (SELECT * FROM {_QRELS}),
b AS (SELECT q.qid, count(r.qid) AS n, min(CASE WHEN g.doc_id IS NOT NULL THEN rank END) AS best FROM (SELECT DISTINCT qid FROM g) q LEFT JOIN r ON r.qid = q.qid LEFT JOIN g ON g.qid = r.qid AND g.doc_id = r.doc_id GROUP BY q.qid)
SELECT CASE WHEN n = 0 THEN 'nothing_retrieved' WHEN best IS NULL THEN 'not_retrieved' WHEN best > 1 THEN 'low_rank' ELSE 'hit' END AS cause, count(*)::BIGINT AS n FROM b GROUP BY cause""")
def q38_failure_causes(spark, sf_dir):
    asked, docs = _asked(spark, sf_dir), _docs(spark, sf_dir)
    return retrieve.failures(retrieve.bm25(asked, docs), staged(retrieve.containing(asked, docs), "relevant"), k=1)


_ERRORS = [
    (1, 429, "Too many", False, 7, 3),
    (2, 429, None, False, None, 1),
    (3, 403, "PERMISSION_DENIED", False, None, 0),
    (4, 400, "bad field", False, None, 0),
    (5, 503, "overloaded", False, 500, 0),
    (6, None, "timed out", True, None, 0),
    (7, None, "boom", False, None, 0),
]


@query("""SELECT * FROM (VALUES (1::BIGINT, 'rate-limit', 24::INT), (2, 'rate-limit', 10), (3, 'bad-key', 3), (4, 'client-error', 3), (5, 'server-error', 300),
(6, 'network-or-timeout', 3), (7, 'other', 3)) t(id, kind, wait)""")
def q39_error_kinds(spark, sf_dir):
    rows = spark.createDataFrame(_ERRORS, "id long, code int, message string, timed_out boolean, retry_after int, streak int")
    kind = adjudicate.error_kind(F.col("code"), F.col("message"), F.col("timed_out"))
    return rows.select("id", kind.alias("kind"), adjudicate.back_off(kind, F.col("retry_after"), F.col("streak")).alias("wait"))


_Q = lambda s: "'" + s.replace("'", "''") + "'"


@query(f"""WITH t AS (SELECT token, unnest(ids) AS doc_id, generate_subscripts(ids, 1) AS k FROM ({ORACLES["q17_examples"]})),
p AS (SELECT token, k, replace(replace(text, chr(9), ' '), chr(10), ' ') AS s FROM t JOIN documents d ON d.doc_id = t.doc_id),
e AS (SELECT token, string_agg(k || '. ' || s, chr(10) ORDER BY k) AS shown, sum(length(s))::BIGINT AS n_chars FROM p GROUP BY token)
SELECT token, md5(concat_ws(chr(10), {_Q(L.PROMPT_HEAD[0])}, replace({_Q(L.PROMPT_HEAD[1])}, '{{token}}', token), {_Q(L.PROMPT_HEAD[2])}, shown, {", ".join(map(_Q, L.PROMPT_TAIL))})) AS digest, n_chars FROM e""")
def q40_prompts(spark, sf_dir):
    shown = _shown(spark, sf_dir)
    total = F.aggregate("examples", F.lit(0).cast("long"), lambda a, s: a + F.length(s))
    return shown.select("token", F.md5(adjudicate.prompt(F.col("token"), F.col("examples"))).alias("digest"), total.alias("n_chars"))


def _shown(spark, sf_dir):
    """token, examples: up to three whole documents of every benchmark token."""
    docs = _docs(spark, sf_dir)
    ids = vocab.examples(docs, _vocab(spark, sf_dir, "benchmark")).select("token", F.explode("ids").alias("doc_id"))
    lines = ids.join(docs.select("doc_id", T.flat(F.col("text")).alias("s")), "doc_id")
    return lines.groupBy("token").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "s"))), lambda x: x["s"]).alias("examples"))


@query(f"WITH v AS (SELECT count(*)::BIGINT AS n, sum(freq)::BIGINT AS mass FROM {_freq_sql('documents')}) SELECT unnest(['csv', 'json', 'tsv', 'vocabulary']) AS format, n, mass FROM v")
def q41_round_trips(spark, sf_dir):
    words = staged(_vocab(spark, sf_dir), "round-trip")
    path = f"{shared_dir(spark)}/round-trip-{uuid.uuid4().hex}"
    text_tables.write_csv(words, f"{path}/csv")
    text_tables.write_tsv(words, f"{path}/tsv")
    text_tables.write_json(words, f"{path}/json")
    back = {
        "csv": text_tables.read_csv(spark, f"{path}/csv", "token string, freq long"),
        "tsv": text_tables.read_tsv(spark, f"{path}/tsv", "token string, freq long"),
        "json": spark.read.schema("token string, freq long").json(f"{path}/json"),
        "vocabulary": text_tables.read_vocabulary(spark, f"{path}/tsv"),
    }
    rows = [df.join(words, ["token", "freq"]).agg(F.count(F.lit(1)).alias("n"), F.sum("freq").alias("mass")).select(F.lit(k).alias("format"), "n", "mass") for k, df in back.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query(ORACLES["q05_vocabulary"])
def q42_streaming_vocabulary(spark, sf_dir):
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    _docs(spark, sf_dir).select("doc_id", "text").write.parquet(f"{path}/in")
    return vocab_stream.run_once(vocab_stream.vocabulary_counts(vocab_stream.stream_documents(spark, f"{path}/in", files=4)), f"{path}/out")


@query(" UNION ALL ".join(f"SELECT {p}::INT AS percent, (count(*) FILTER (round(running / total * 100, 3) < {p}) + 1)::BIGINT AS n_tokens FROM {_COVER(_UNSURE)}" for p in (70, 80, 90)))
def q14c_percent_ranks(spark, sf_dir):
    return _percent_ranks(vocab.coverage(_labelled(spark, sf_dir).filter("label = 'UNCERTAIN_NEEDS_LLM'").select("token", "freq")))


def _percent_ranks(covered):
    ranks = vocab.ranks_at_percent(covered, [70, 80, 90])
    return ranks.select(F.inline(F.array(*[F.struct(F.lit(p).alias("percent"), F.col(f"n_{p}").alias("n_tokens")) for p in (70, 80, 90)])))


@query(f"""WITH q AS (SELECT item_id AS qid, list_distinct({T.tokens_sql("text")}) AS qt FROM benchmark), d AS (SELECT doc_id, list_distinct({T.tokens_sql("text")}) AS dt FROM documents),
s AS (SELECT r.*, round(len(list_intersect(qt, dt)) / len(list_distinct(list_concat(qt, dt))), 6) AS score2 FROM {_BM25} r JOIN q USING (qid) JOIN d USING (doc_id))
SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score2 DESC, rank) AS rank, score, score2 FROM s""")
def q43_rerank(spark, sf_dir):
    asked, docs = _asked(spark, sf_dir), _docs(spark, sf_dir)
    run = staged(retrieve.bm25(asked, docs), "bm25-run")
    distinct = lambda c: F.array_distinct(T.tokens(F.col(c)))
    found = docs.select("doc_id", "text").join(small(run.select("qid", "doc_id")), "doc_id").select("qid", "doc_id", distinct("text").alias("d"))
    pairs = found.join(asked.select("qid", distinct("query").alias("q")), "qid")
    shared = F.round(F.size(F.array_intersect("q", "d")) / F.size(F.array_union("q", "d")), 6)
    return retrieve.rerank(run, pairs.select("qid", "doc_id", shared.alias("score2")))


@query(f"SELECT DISTINCT replace(lower(token), '_', '') AS lemma FROM {_freq_sql('documents')} WHERE regexp_matches(replace(lower(token), '_', ''), '^\\p{{L}}+$')")
def q44_lemmas(spark, sf_dir):
    return _vocab(spark, sf_dir).select(T.lemma(F.col("token")).alias("lemma")).filter("lemma is not null").distinct()


_REPAIRED = "text"
for _sign, _plain in T.PLAIN.items():
    _REPAIRED = f"replace({_REPAIRED}, {_Q(_sign)}, {_Q(_plain)})"


@query(f"SELECT doc_id, md5(nfc_normalize({_REPAIRED})) AS digest FROM documents")
def q45_repaired_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.repair_unicode(F.col("text"))).alias("digest"))


def spelling_variants(token: str) -> list[str]:
    """Offline stand-in for a transliterator: fails on digits."""
    if any(c in "0123456789" for c in token):
        raise ValueError("digits")
    return [token, f"{token}a", f"{token}aa"]


@query(f"""SELECT token, CASE WHEN regexp_matches(token, '[0-9]') THEN '' ELSE token || '|' || token || 'a|' || token || 'aa' END AS candidates,
CASE WHEN regexp_matches(token, '[0-9]') THEN 'digits' END AS error FROM {_freq_sql("documents")}""")
def q46_candidates(spark, sf_dir):
    return canon.candidates(_vocab(spark, sf_dir), spelling_variants).select("token", F.array_join("candidates", "|").alias("candidates"), "error")


def offline_adjudicator(text: str) -> str:
    """Offline stand-in for a language model: fails on digits, answers short tokens plainly and long ones in a fenced block."""
    token = text.split('Token: "', 1)[1].split('"\nExample', 1)[0]
    if any(c in "0123456789" for c in token):
        raise ValueError("digits")
    return '{"label": "HINGLISH", "reason": "short"}' if len(token) < 4 else 'So:\n```json\n{"label": "english"}\n```'


@query(f"""SELECT token, freq, CASE WHEN regexp_matches(token, '[0-9]') OR length(token) < 4 THEN 'HINGLISH' ELSE 'ENGLISH' END AS label,
CASE WHEN regexp_matches(token, '[0-9]') THEN 'llm_call_failed_default:ValueError: digits' WHEN length(token) < 4 THEN 'short' ELSE '' END AS reason
FROM {_freq_sql("documents")} WHERE token IN (SELECT token FROM {_freq_sql("benchmark")})""")
def q47_adjudicated(spark, sf_dir):
    words, shown = _vocab(spark, sf_dir), _shown(spark, sf_dir)
    prompts = shown.select("token", adjudicate.prompt(F.col("token"), F.col("examples")).alias("prompt"))
    answers = adjudicate.call_model(prompts, offline_adjudicator)
    return adjudicate.decide(words.join(shown, "token").join(answers, "token"))


@query()
def q48_matcher_ratio(spark, sf_dir):
    pairs = read(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    return pairs.withColumn("ratio", F.round(matcher_ratio(F.col("p_type"), F.col("p_brand")), 6))


@query(f"""WITH c AS (SELECT label, count(*) AS n, sum(freq) AS mass FROM {_LABELLED} GROUP BY label), e AS (SELECT unnest(['{"', '".join(L.LABELS)}']) AS label)
SELECT e.label, coalesce(n, 0)::BIGINT AS n, coalesce(mass, 0)::BIGINT AS mass FROM e LEFT JOIN c ON e.label = c.label""")
def q49_split_files(spark, sf_dir):
    return _split_files(spark, _labelled(spark, sf_dir))


def _split_files(spark, labelled):
    path = f"{shared_dir(spark)}/split-{uuid.uuid4().hex}"
    text_tables.write_split(labelled, path, {name: f"label = '{name}'" for name in L.LABELS})
    counts = [F.count("token").alias("n"), F.coalesce(F.sum("freq"), F.lit(0)).alias("mass")]
    parts = [text_tables.read_tsv(spark, f"{path}/{name}", "token string, freq long, label string, method string").agg(*counts).select(F.lit(name).alias("label"), "n", "mass") for name in L.LABELS]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("SELECT 'lite-2' AS name")
def q50_preferred_name(spark, sf_dir):
    names = spark.createDataFrame([("models/old-preview", 0), ("models/lite-2", 1), ("models/lite-1", 2)], "name string, pos int")
    return adjudicate.preferred(names, ["full-3", "lite-2", "lite-1"])


@query("SELECT '{' || string_agg('\"' || k || '\":\"' || v || '\"', ',' ORDER BY k) || '}' AS json FROM (SELECT unnest([" + ", ".join(_Q(k) for k, _ in L.CANONICAL_MAP) + "]) AS k, unnest([" + ", ".join(_Q(v) for _, v in L.CANONICAL_MAP) + "]) AS v)")
def q51_map_as_json(spark, sf_dir):
    return canon.as_json(spark.createDataFrame(list(L.CANONICAL_MAP), "token string, form string"))


@query("SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, count(*)::BIGINT AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def q52_event_windows(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")  # watermarks need an instant
    path = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    events.write.parquet(f"{path}/in")
    stream = vocab_stream.stream_documents(spark, f"{path}/in", events.schema)
    out = vocab_stream.run_once(vocab_stream.windowed_counts(stream, "ts", "1 hour", "1 day", "event_type"), f"{path}/out")
    return out.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "n")


@query(f"SELECT doc_id, len({T.tokens_sql('text')}) < 4 AS short FROM documents")
def q53_stream_labels(spark, sf_dir):
    path = f"{shared_dir(spark)}/labels-{uuid.uuid4().hex}"
    _docs(spark, sf_dir).select("doc_id", "text").write.parquet(f"{path}/in")
    stream = vocab_stream.stream_documents(spark, f"{path}/in")
    vocab_stream.append_labelled(stream, lambda batch: batch.select("doc_id", dedup.short_flag(batch, "text").alias("short")), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").select("doc_id", "short")


@query(f"SELECT token FROM {_freq_sql('documents')} INTERSECT SELECT unnest([{', '.join(map(_Q, L.AMBIGUOUS_OVERRIDE))}])")
def q54_leaked_tokens(spark, sf_dir):
    return canon.leaked(_vocab(spark, sf_dir), spark.createDataFrame([(t,) for t in L.AMBIGUOUS_OVERRIDE], "token string"))


@query(f"""SELECT 0 AS pos, '| label | method | n_tokens |' AS line UNION ALL SELECT 1, '|-|-|-|' UNION ALL
SELECT 1 + row_number() OVER (ORDER BY n_tokens DESC, label, method), '| ' || label || ' | ' || method || ' | ' || n_tokens || ' |' FROM (SELECT label, method, count(*) AS n_tokens FROM {_LABELLED} GROUP BY label, method)""")
def q55_report_lines(spark, sf_dir):
    return _report_lines(_labelled(spark, sf_dir))


def _report_lines(labelled):
    summary = vocab.label_mass(labelled).select("label", "method", "n_tokens")
    return text_tables.markdown(summary, [F.desc("n_tokens"), F.asc("label"), F.asc("method")])


def _uncertain(spark, sf_dir):
    return vocab.coverage(_cascade(spark, sf_dir).filter("label = 'UNCERTAIN_NEEDS_LLM'").select("token", "freq"))


@query(ORACLES["q09_rules_cascade"].replace(_LABELLED, _CASCADE))
def q56_whole_cascade(spark, sf_dir):
    """As q09 with the fuzzy rule; a test compares it with brute force. q57 to q62 are q11, q12, q14c, q15, q49 and q55 over it."""
    return _cascade(spark, sf_dir)


@query(ORACLES["q11_label_histogram"].replace(_LABELLED, _CASCADE))
def q57_whole_histogram(spark, sf_dir):
    return vocab.histogram(_cascade(spark, sf_dir), "label", L.LABELS)


@query(ORACLES["q12_label_mass"].replace(_LABELLED, _CASCADE))
def q58_whole_label_mass(spark, sf_dir):
    return vocab.label_mass(_cascade(spark, sf_dir))


@query(ORACLES["q14c_percent_ranks"].replace(_LABELLED, _CASCADE))
def q59_whole_percent_ranks(spark, sf_dir):
    return _percent_ranks(_uncertain(spark, sf_dir))


@query(ORACLES["q15_pilot_pool"].replace(_LABELLED, _CASCADE))
def q60_whole_pilot_pool(spark, sf_dir):
    return vocab.pilot_pool(_uncertain(spark, sf_dir))


@query(ORACLES["q49_split_files"].replace(_LABELLED, _CASCADE))
def q61_whole_split_files(spark, sf_dir):
    return _split_files(spark, _cascade(spark, sf_dir))


@query(ORACLES["q55_report_lines"].replace(_LABELLED, _CASCADE))
def q62_whole_report_lines(spark, sf_dir):
    return _report_lines(_cascade(spark, sf_dir))


def _pairs_sql(source: str, n_words: int) -> str:
    """benchmark_pairs over a SELECT of doc_id, text."""
    words = f"list_filter(regexp_split_to_array(coalesce(text, ''), '[{T.SPACE}]+'), lambda x: x <> '')"
    passages = f"""SELECT doc_id, array_to_string(w[p + 1 : p + {n_words}], ' ') AS text FROM (
  SELECT doc_id, w, ('0x' || substr(md5('42' || doc_id), 1, 8))::BIGINT % greatest(len(w) - {n_words} + 1, 1) AS p FROM (SELECT doc_id, {words} AS w FROM ({source})) WHERE len(w) > 0)"""
    return " UNION ALL ".join(f"SELECT doc_id || '-' || {k} AS qid, {k}::INT AS level, {e} AS query, doc_id FROM ({passages})" for k, e in _NOISE.items())


@query(_pairs_sql("SELECT doc_id, text FROM documents", 8))
def q63_benchmark_pairs(spark, sf_dir):
    return retrieve.benchmark_pairs(_docs(spark, sf_dir))


_ITEMS = "SELECT item_id AS doc_id, text FROM benchmark"


@query(f"""WITH p AS ({_pairs_sql(_ITEMS, 5)}), r AS {_bm25_sql(f"SELECT qid, query AS text FROM ({_pairs_sql(_ITEMS, 5)})", _ITEMS)},
f AS (SELECT p.qid, level, min(rank) AS best FROM p LEFT JOIN r ON r.qid = p.qid AND r.doc_id = p.doc_id GROUP BY ALL),
m AS (SELECT level, round(avg(coalesce(1 / best, 0)), 6) AS score FROM f GROUP BY level)
SELECT 'bm25' AS system, level, score, CASE WHEN b > 0 THEN round(100 * (1 - score / b), 6) END AS drop FROM (SELECT *, max(score) FILTER (level = 1) OVER () AS b FROM m)""")
def q64_noise_drop(spark, sf_dir):
    """Generated queries against the passages that they come from: mean reciprocal rank at each noise level, and its drop against level 1."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    pairs = staged(retrieve.benchmark_pairs(items, 5), "benchmark-pairs")
    run = retrieve.bm25(pairs.select("qid", "query"), items)
    best = pairs.join(run, ["qid", "doc_id"], "left").groupBy("qid", "level").agg(F.min("rank").alias("best"))
    scores = best.groupBy("level").agg(F.round(F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))), 6).alias("score"))
    return retrieve.relative_drop(scores.withColumn("system", F.lit("bm25")), 1)


_PICKS = "CASE WHEN length(token) % 5 = 0 THEN '{\"pick\": 2, \"reason\": \"second\"}' WHEN length(token) % 5 = 1 THEN 'Sure: {\"pick\": \"' || token || '0\"}' WHEN length(token) % 5 = 2 THEN '{\"pick\": 0, \"reason\": \"none usable\"}' WHEN length(token) % 5 = 3 THEN '{\"pick\": 9}' END"


@query(f"""SELECT token, CASE length(token) % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 END::INT AS pick, CASE length(token) % 5 WHEN 0 THEN reverse(token) WHEN 1 THEN token || '0' END AS form,
CASE length(token) % 5 WHEN 0 THEN 'second' WHEN 2 THEN 'none usable' WHEN 4 THEN 'llm_call_failed:timeout' ELSE '' END AS reason
FROM {_freq_sql("benchmark")} WHERE regexp_matches(token, '^[a-z]+$') AND token <> reverse(token)""")
def q65_selected_candidates(spark, sf_dir):
    t = F.col("token")
    rows = _vocab(spark, sf_dir, "benchmark").filter(t.rlike(ASCII) & (t != F.reverse(t)))
    rows = rows.select("token", F.array(t, F.reverse(t), F.concat(t, F.lit("0"))).alias("candidates"), F.expr(_PICKS).alias("response"), F.lit("timeout").alias("error"))
    return adjudicate.select_candidate(rows)


def _chosen(spark, sf_dir):
    """Benchmark tokens with a stand-in for their Devanagari form: the token without h."""
    return _vocab(spark, sf_dir, "benchmark").withColumn("form", F.replace(F.lower("token"), F.lit("h"), F.lit("")))


def _clusters_sql(where: str) -> str:
    """Signature clusters of the stand-in forms: components of all similar pairs by their transitive closure."""
    near = _distance_sql("SELECT x.form AS a, y.form AS b FROM f x JOIN f y ON x.form < y.form")
    return f"""(WITH RECURSIVE c AS (SELECT token, freq, replace(lower(token), 'h', '') AS form FROM {_freq_sql("benchmark")} WHERE replace(lower(token), 'h', '') <> '' AND {where}),
f AS (SELECT DISTINCT form FROM c), e AS (SELECT a, b FROM {near} WHERE 1 - distance / greatest(length(a), length(b)) >= 0.75),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(x, y) AS (SELECT form, form FROM f UNION SELECT r.x, u.b FROM r JOIN u ON r.y = u.a),
o AS (SELECT x, min(y) AS root FROM r GROUP BY x)
SELECT min(token) AS cluster_id, first(token ORDER BY freq DESC, token) AS canonical_roman, first(form ORDER BY freq DESC, token) AS canonical_devanagari, list(token ORDER BY token) AS members, sum(freq)::BIGINT AS freq
FROM c JOIN o ON form = x GROUP BY root)"""


@query(f"SELECT * FROM {_clusters_sql('true')}")
def q66_signature_clusters(spark, sf_dir):
    return canon.signature_clusters(_chosen(spark, sf_dir))


@query(f"""WITH k AS {_clusters_sql("freq > 1")}, t AS (SELECT token FROM {_freq_sql("benchmark")}),
d AS (SELECT * FROM {_distance_sql("SELECT DISTINCT least(token, canonical_devanagari) AS a, greatest(token, canonical_devanagari) AS b FROM t, k")}),
p AS (SELECT token, k.*, least(token, canonical_devanagari) AS low, greatest(token, canonical_devanagari) AS high FROM t CROSS JOIN k),
s AS (SELECT p.*, greatest(0, 1 - distance / greatest(length(a), length(b))) AS similarity FROM p JOIN d ON a = low AND b = high),
m AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY round(similarity, 9) DESC, freq DESC, cluster_id) AS n FROM s WHERE similarity >= 0.75)
SELECT t.token, t.token AS form, cluster_id, coalesce(canonical_roman, t.token) AS normalized, similarity FROM t LEFT JOIN m ON m.token = t.token AND n = 1""")
def q67_signature_matches(spark, sf_dir):
    known = staged(canon.signature_clusters(_chosen(spark, sf_dir).filter("freq > 1")), "known-clusters")
    return canon.match_signatures(_vocab(spark, sf_dir, "benchmark").select("token", F.col("token").alias("form")), known)


@query("""SELECT p_partkey, CASE WHEN trim(k) = '' THEN 'missing' WHEN lower(trim(k)) IN ('changeme', 'change_me', 'none', 'null', 'placeholder', 'test', 'todo', 'xxx') OR starts_with(lower(trim(k)), 'your') THEN 'placeholder'
WHEN length(trim(k)) < 10 THEN 'too short' END AS problem FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN 'YOUR_' || p_name WHEN 2 THEN left(p_name, 6) WHEN 3 THEN ' ' ELSE 'Test' END AS k FROM part)""")
def q68_key_problems(spark, sf_dir):
    m = F.col("p_partkey") % 5
    key = F.when(m == 0, F.col("p_name")).when(m == 1, F.concat(F.lit("YOUR_"), "p_name")).when(m == 2, F.substring("p_name", 1, 6)).when(m == 3, " ").otherwise("Test")
    return read(spark, sf_dir, "part").select("p_partkey", T.key_problem(key).alias("problem"))


@query(f"SELECT source, count(*)::BIGINT AS n, sum(freq)::BIGINT AS mass FROM ({ORACLES['q21_merge_pool']}) GROUP BY source")
def q69_source_counts(spark, sf_dir):
    return canon.source_counts(q21_merge_pool(spark, sf_dir))


_RANKS = (1, 10, 100, 1_000_000)


@query(" UNION ALL ".join(f"SELECT {r}::BIGINT AS rank, round(100 * max(running) FILTER (rank <= {r}) / max(total), 4) AS share FROM {_COVER(_SHORT)}" for r in _RANKS))
def q70_share_at_rank(spark, sf_dir):
    return vocab.share_at_rank(_collisions(spark, sf_dir), list(_RANKS))


@query()
def q71_largest_groups(spark, sf_dir):
    return dedup.group_sizes(q20_near_groups(spark, sf_dir))


@query(f"""WITH v AS {_freq_sql("documents")} SELECT 'tokens' AS measure, (SELECT count(*) FROM v)::BIGINT AS got, 29579::BIGINT AS documented, CASE WHEN (SELECT count(*) FROM v) <> 29579 THEN 'differs from the documented baseline' END AS warning
UNION ALL SELECT 'mass', (SELECT sum(freq) FROM v)::BIGINT, 165692, CASE WHEN (SELECT sum(freq) FROM v) <> 165692 THEN 'differs from the documented baseline' END""")
def q72_against_baseline(spark, sf_dir):
    return canon.against_baseline(_vocab(spark, sf_dir), 29579, 165692)


@query("""WITH m AS (SELECT event_type AS system, user_id % 3 AS stage, avg(value) AS mean FROM events GROUP BY ALL), t AS (SELECT system, sum(mean) AS total FROM m GROUP BY system)
SELECT system, round(total, 6) AS total, round(total - max(total) FILTER (system = (SELECT min(system) FROM t)) OVER (), 6) AS added, round(max(total) OVER () / total, 6) AS speed_up FROM t""")
def q73_latency_totals(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(F.col("event_type").alias("system"), (F.col("user_id") % 3).alias("stage"), F.col("value").alias("ms"))
    return retrieve.latency_totals(events, events.agg(F.min("system")).first()[0])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 50 > 0 THEN o_totalprice / (o_orderkey % 50) * 1000 END AS ms_per_item, CASE WHEN o_orderkey % 50 > 0 THEN o_totalprice / (o_orderkey % 50) * (50 - o_orderkey % 50) / 60 END AS minutes_left FROM orders")
def q74_progress(spark, sf_dir):
    done = F.col("o_orderkey") % 50
    return read(spark, sf_dir, "orders").select("o_orderkey", evaluate.progress(done, F.lit(50), F.col("o_totalprice")).alias("p")).select("o_orderkey", "p.*")


@query(f"""WITH v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS pos FROM {_freq_sql("benchmark")})
SELECT pos::BIGINT AS pos, token AS first, CASE WHEN pos % 7 <> 0 THEN token END AS second, CASE WHEN pos % 5 <> 0 THEN reverse(token) END AS single FROM v""")
def q75_aligned_lists(spark, sf_dir):
    v = vocab.coverage(_vocab(spark, sf_dir, "benchmark").select("token", F.lit(0).alias("freq"))).select((F.col("rank") - 1).alias("pos"), "token")
    lists = staged(v, "aligned")
    out = canon.aligned(lists.select("pos", F.array("token").alias("candidates")), lists.filter("pos % 7 != 0").select("pos", F.array("token").alias("candidates")), lists.filter("pos % 5 != 0").select("pos", F.array(F.reverse("token")).alias("candidates")))
    return out.select("pos", *[F.get(c, F.lit(0)).alias(name) for c, name in (("first_run", "first"), ("second_run", "second"), ("single", "single"))])


@query(f"""WITH m AS (SELECT label, method, count(*) AS n FROM {_LABELLED} GROUP BY ALL), r AS (SELECT row_number() OVER (ORDER BY n DESC, label, method) AS pos, label, method, n::VARCHAR AS n FROM m UNION ALL SELECT 0, 'label', 'method', 'n_tokens')
SELECT pos::BIGINT AS pos, rtrim(rpad(label, (max(length(label)) OVER ())::INT, ' ') || '  ' || rpad(method, (max(length(method)) OVER ())::INT, ' ') || '  ' || lpad(n, (max(length(n)) OVER ())::INT, ' ')) AS line FROM r""")
def q76_console_table(spark, sf_dir):
    return text_tables.console(vocab.label_mass(_labelled(spark, sf_dir)).select("label", "method", "n_tokens"), [F.desc("n_tokens"), F.asc("label"), F.asc("method")])


@query(f"SELECT label, n, repeat('#', round(40 * n / max(n) OVER ())::INT) AS bar FROM (SELECT label, count(*)::BIGINT AS n FROM {_LABELLED} GROUP BY label)")
def q77_bars(spark, sf_dir):
    counts = _labelled(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return evaluate.bars(counts, "label", "n")


@query(r"SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL AND nfc_normalize(text) = text AND NOT regexp_matches(text, '[\x{80}-\x{BF}\x{2018}\x{2019}\x{201C}\x{201D}\x{FB00}-\x{FB02}]')")
def q78_misread_text(spark, sf_dir):
    """Texts read as Latin-1 by mistake come back as they were (texts with signs that repair makes plain aside)."""
    docs = _docs(spark, sf_dir).filter(~F.col("text").rlike(r"[\x{80}-\x{BF}\x{2018}\x{2019}\x{201C}\x{201D}\x{FB00}-\x{FB02}]"))
    misread = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return docs.select("doc_id", F.md5(T.repair_unicode(misread)).alias("digest"))


@query()
def q79_provenance(spark, sf_dir):
    words = staged(_chosen(spark, sf_dir), "provenance-words")
    routed = classify.route(words.select("token"), _english(spark, sf_dir))
    picked = adjudicate.select_candidate(words.select("token", F.array("form").alias("candidates"), F.lit('{"pick": 1, "reason": "only one"}').alias("response"), F.lit(None).cast("string").alias("error")))
    out = canon.provenance(routed, canon.candidates(words, spelling_variants), picked, canon.signature_clusters(words))
    return out.withColumn("candidates", F.array_join("candidates", "|"))


@query(f"SELECT token FROM {_freq_sql('documents')} UNION SELECT token FROM {_freq_sql('benchmark')} UNION SELECT token FROM {_freq_sql('conversations')}")
def q80_joined_vocabularies(spark, sf_dir):
    return vocab.union_of(*(_vocab(spark, sf_dir, n) for n in ("documents", "benchmark", "conversations")))


_CALL = """SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 429 WHEN 2 THEN 403 WHEN 3 THEN 503 WHEN 4 THEN 400 WHEN 5 THEN 401 WHEN 6 THEN 200 END AS code,
CASE l_returnflag WHEN 'A' THEN 'API key not valid' WHEN 'N' THEN 'PERMISSION_DENIED' END AS message, l_linestatus = 'F' AND l_linenumber = 7 AS timed_out,
CASE WHEN l_quantity > 10 THEN CAST(l_quantity AS INT) END AS retry_after, CAST(l_suppkey % 5 AS INT) AS streak FROM """


@query(f"""WITH k AS (SELECT *, CASE WHEN timed_out THEN 'network-or-timeout' WHEN code = 429 THEN 'rate-limit' WHEN code IN (400, 401, 403) AND message IS NOT NULL THEN 'bad-key'
  WHEN code BETWEEN 500 AND 599 THEN 'server-error' WHEN code IS NOT NULL THEN 'client-error' ELSE 'other' END AS kind FROM ({_CALL} lineitem))
SELECT l_orderkey, l_linenumber, kind, least(CASE WHEN kind = 'rate-limit' THEN greatest(coalesce(retry_after + 1, 3) * streak, 10) ELSE coalesce(retry_after + 1, 3) END, 300)::INT AS wait FROM k""")
def q81_error_kinds_of_calls(spark, sf_dir):
    rows = spark.sql(_CALL + "{calls}", calls=read(spark, sf_dir, "lineitem"))
    kind = adjudicate.error_kind(F.col("code"), F.col("message"), F.col("timed_out"))
    return rows.select("l_orderkey", "l_linenumber", kind.alias("kind"), adjudicate.back_off(kind, F.col("retry_after"), F.col("streak")).alias("wait"))


@query(f"""WITH v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS pos FROM {_freq_sql("benchmark")})
SELECT count(*)::BIGINT AS n, true AS complete, count(*) FILTER (pos % 7 = 0) = 0 AS deterministic, count(*) FILTER (pos % 5 = 0 OR reverse(token) <> token)::BIGINT AS mismatches, count(*) FILTER (pos % 7 = 0 OR pos % 5 = 0 OR reverse(token) <> token) = 0 AS trusted FROM v""")
def q82_gate_of_aligned_lists(spark, sf_dir):
    rows = q75_aligned_lists(spark, sf_dir)
    return canon.batch_gate(rows.select("pos", *[F.when(F.col(c).isNotNull(), F.array(c)).alias(name) for c, name in (("first", "first_run"), ("second", "second_run"), ("single", "single"))]))


@query(f"""SELECT '{{' || string_agg('"' || token || '":"' || reverse(token) || '"', ',' ORDER BY token) || '}}' AS json FROM {_freq_sql("benchmark")} WHERE regexp_matches(token, '^[a-z]+$')""")
def q83_benchmark_map_as_json(spark, sf_dir):
    words = _vocab(spark, sf_dir, "benchmark").filter(F.col("token").rlike(ASCII))
    return canon.as_json(words.select("token", F.reverse("token").alias("form")))


@query(f"""WITH w AS (SELECT token, label, CASE WHEN length(token) < 4 THEN 'HINGLISH' ELSE 'ENGLISH' END AS want FROM {_LABELLED}),
c AS (SELECT count(*) FILTER (label = want) AS correct, count(*) FILTER (label IN ('UNCERTAIN_NEEDS_LLM', 'AMBIGUOUS')) AS deferred, count(*) AS total FROM w)
SELECT correct::BIGINT AS correct, deferred::BIGINT AS deferred, (total - correct - deferred)::BIGINT AS wrong, round(100 * correct / total, 4) AS accuracy FROM c""")
def q84_tally_of_vocabulary(spark, sf_dir):
    """The self-test's tally over the whole vocabulary: short tokens stand in for Hinglish ones."""
    labelled = staged(_labelled(spark, sf_dir), "tally")
    return classify.self_test(labelled, labelled.select("token", F.when(F.length("token") < 4, "HINGLISH").otherwise("ENGLISH").alias("want")))


@query("SELECT coalesce(max(p_name), 'none') AS name FROM part WHERE contains(p_name, 'a')")
def q85_preferred_part(spark, sf_dir):
    """The preferred name is the last of its family in the catalogue, which lists it under a prefix."""
    names = read(spark, sf_dir, "part").select(F.concat(F.lit("models/"), "p_name").alias("name"), F.col("p_partkey").alias("pos"))
    best = names.filter(F.col("name").contains("a")).agg(F.max("name")).first()[0]
    return adjudicate.preferred(names, ["no such name", (best or "").removeprefix("models/")], "a", "none")


def flagship(spark, sf_dir):
    """Clean, count and label: the most frequent tokens of cleaned documents with their labels."""
    docs = _docs(spark, sf_dir).withColumn("text", T.clean(F.col("text")))
    words = vocab.document_frequency(docs)
    return vocab.top(_cascade(spark, sf_dir, words), 100)
