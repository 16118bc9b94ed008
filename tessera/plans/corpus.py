from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import reports as rep
from ..operators import scoring as sc
from ..operators.medians import medians
from ..sources.tables import hash_id, spread, table
from .registry import query

_STOP = "(" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + ")"
#: Tokens by RE2, which has no look-behind: a mark between cases, then a split.
_TOKENS = (
    r"list_filter(list_transform(flatten(list_transform(regexp_extract_all({0}, '[A-Za-z][A-Za-z0-9]+'), lambda w: string_split(regexp_replace(w, '([a-z0-9])([A-Z])', '\1 \2', 'g'), ' '))), lambda t: lower(t)),"
    f" lambda t: length(t) >= 4 AND t NOT IN {_STOP})"
)
_DF = "SELECT token, count(*) AS docs FROM (SELECT unnest(list_distinct(%s)) AS token FROM {0}) GROUP BY token" % _TOKENS.format("text")

# Criteria and their signals, for the driver's synthetic texts.
CRITERIA = {"license": ("licensed under", "copyright"), "contact": ("@", "tel"), "secret": ("password", "token"), "markup": (" | ", "###"), "emphasis": ("!!", "***")}
_MET = [f"({' OR '.join(f'''contains(lower(coalesce(text, '')), '{s}')''' for s in signals)})" for signals in CRITERIA.values()]
_N_MET = " + ".join(f"{m}::INT" for m in _MET)
_SCORE = f"round_even(100.0 * ({_N_MET}) / {len(CRITERIA)}, 0)::INT"


@query("SELECT source, lang, count(*) AS files, sum(len(string_split(text, chr(10))))::BIGINT AS lines, count(*) FILTER (n_chars > 2000) AS long_files, max(n_chars) AS longest FROM documents GROUP BY ALL")
def corpus_rollup(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source", "lang").agg(F.count("*").alias("files"), F.sum(F.size(F.split("text", "\n"))).alias("lines"), F.count_if(F.col("n_chars") > 2000).alias("long_files"), F.max("n_chars").alias("longest"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS sha, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS duplicate FROM documents")
def dup_first_seen(spark, sf_dir):
    """First occurrence by hash: the smallest id of a hash, by an aggregate that combines before the shuffle."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.sha2("text", 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first"))
    return d.join(first, "h").select("doc_id", F.substring("h", 1, 16).alias("sha"), (F.col("doc_id") > F.col("first")).alias("duplicate"))


@query("SELECT lang, count(*) AS blocks, count(DISTINCT text) AS distinct_blocks, round(1.0 - count(DISTINCT text) / count(*), 6) AS dedup_ratio FROM documents GROUP BY lang")
def dedup_ratio_by_kind(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("lang", F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"))
    return d.groupBy("lang").agg(F.sum("n").alias("blocks"), F.count("*").alias("distinct_blocks"), F.round(1.0 - F.count("*") / F.sum("n"), 6).alias("dedup_ratio"))


@query(f"WITH t AS (SELECT item_id, list_distinct({_TOKENS.format('text')}) AS w FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END, 6) AS jaccard FROM t a JOIN t b ON a.item_id < b.item_id")
def jaccard_pairs(spark, sf_dir):
    """All pairs of the benchmark's items, a stated small set, by shared tokens."""
    t = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(tx.tokens(F.col("text"))).alias("w"))
    a, b = t.select(F.col("item_id").alias("a"), F.col("w").alias("wa")), t.select(F.col("item_id").alias("b"), F.col("w").alias("wb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(tx.overlap(F.col("wa"), F.col("wb")), 6).alias("jaccard"))


@query(_DF.format("documents"))
def token_doc_freq(spark, sf_dir):
    return sc.document_frequency(spread(table(spark, sf_dir, "documents").select("text")))


_EN, _DE = "(SELECT * FROM documents WHERE lang = 'en')", "(SELECT * FROM documents WHERE lang = 'de')"


@query(f"SELECT a.token, a.docs FROM ({_DF.format(_EN)}) a WHERE docs >= 2 AND NOT EXISTS (SELECT 1 FROM ({_DF.format(_DE)}) b WHERE b.token = a.token)")
def distinctive_vocab(spark, sf_dir):
    """Tokens of two or more English texts that no German text has."""
    d = spread(table(spark, sf_dir, "documents").select("lang", "text"))
    return sc.vocabularies(d, F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 2)).filter("side = 1").select("token", "docs")


@query(f"""
WITH en AS ({_DF.format(_EN)}), de AS ({_DF.format(_DE)}),
fi AS (SELECT token FROM en WHERE docs >= 2 AND token NOT IN (SELECT token FROM de)), cr AS (SELECT token FROM de WHERE docs >= 2 AND token NOT IN (SELECT token FROM en)),
w AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS token FROM documents),
h AS (SELECT d.doc_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM documents d LEFT JOIN (SELECT doc_id, count(*) FILTER (token IN (SELECT token FROM fi)) AS a, count(*) FILTER (token IN (SELECT token FROM cr)) AS b FROM w GROUP BY doc_id) USING (doc_id)),
p AS (SELECT doc_id, a / (a + b + 1.0) AS p1, b / (a + b + 1.0) AS p2, 1.0 / (a + b + 1.0) AS p3 FROM h),
r AS (SELECT *, list_sort([p1, p2, p3], 'DESC') AS s, CASE WHEN p1 >= p2 AND p1 >= p3 THEN 'first' WHEN p2 >= p3 THEN 'second' ELSE 'shared' END AS predicted FROM p)
SELECT doc_id, round(p1, 6) AS p_first, round(p2, 6) AS p_second, round(p3, 6) AS p_shared, predicted, round(s[1] - s[2], 6) AS margin, predicted <> 'second' OR s[1] - s[2] < 0.2 AS kept FROM r""")
def lexical_vote(spark, sf_dir):
    """English against German vocabulary, with the asymmetric keep rule."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return sc.votes(d, sc.vocabularies(d, F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 2)))


@query(f"""
WITH en AS ({_DF.format(_EN)}), de AS ({_DF.format(_DE)}),
fi AS (SELECT token FROM en WHERE docs >= 2 AND token NOT IN (SELECT token FROM de)), cr AS (SELECT token FROM de WHERE docs >= 2 AND token NOT IN (SELECT token FROM en)),
w AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS token FROM documents),
h AS (SELECT d.doc_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM documents d LEFT JOIN (SELECT doc_id, count(*) FILTER (token IN (SELECT token FROM fi)) AS a, count(*) FILTER (token IN (SELECT token FROM cr)) AS b FROM w GROUP BY doc_id) USING (doc_id)),
p AS (SELECT doc_id, a / (a + b + 1.0) AS p1, b / (a + b + 1.0) AS p2, 1.0 / (a + b + 1.0) AS p3 FROM h),
q AS (SELECT p.doc_id, CASE WHEN doc_id % 5 = 0 THEN p1 ELSE (p1 + (1 + doc_id % 3) / 6.0) / 2 END AS p1, CASE WHEN doc_id % 5 = 0 THEN p2 ELSE (p2 + 2 / 6.0) / 2 END AS p2, CASE WHEN doc_id % 5 = 0 THEN p3 ELSE (p3 + (3 - doc_id % 3) / 6.0) / 2 END AS p3 FROM p),
r AS (SELECT *, list_sort([p1, p2, p3], 'DESC') AS s, CASE WHEN p1 >= p2 AND p1 >= p3 THEN 'first' WHEN p2 >= p3 THEN 'second' ELSE 'shared' END AS predicted FROM q)
SELECT doc_id, round(p1, 6) AS p_first, round(p2, 6) AS p_second, round(p3, 6) AS p_shared, predicted, round(s[1] - s[2], 6) AS margin, predicted <> 'second' OR s[1] - s[2] < 0.2 AS kept FROM r""")
def fused_vote(spark, sf_dir):
    """Two arms, the lexical one and a model's shares (here made from the id, none for every fifth), averaged."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    k = F.col("doc_id")
    model = d.filter(k % 5 != 0).select("doc_id", ((1 + k % 3) / 6.0).alias("p_first"), F.lit(2 / 6.0).alias("p_second"), ((3 - k % 3) / 6.0).alias("p_shared"))
    marked = sc.vocabularies(d, F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 2))
    return sc.decided(sc.fused_shares(sc.lexical_shares(d, marked), model))


@query(f"SELECT doc_id, {_SCORE} AS score, ({_N_MET})::INT AS n_met FROM documents")
def criteria_score(spark, sf_dir):
    score, met, _ = sc.criteria(F.col("text"), CRITERIA)
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("score"), F.size(met).alias("n_met"))


@query(f"""
WITH m AS (SELECT source, floor(quantile_cont({_SCORE}, 0.5))::INT AS median_score, min({_SCORE}) AS low, max({_SCORE}) AS high FROM documents GROUP BY source)
SELECT source, median_score, low, high FROM m""")
def int_median_by_group(spark, sf_dir):
    score, _, _ = sc.criteria(F.col("text"), CRITERIA)
    m = medians(spread(table(spark, sf_dir, "documents").select("source", "text")).select("source", score.alias("score")), "source", "score")
    return m.select("source", F.floor("median").cast("int").alias("median_score"), F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high"))


@query(f"""
WITH m AS (SELECT source, floor(quantile_cont({_SCORE}, 0.5))::INT AS s FROM documents GROUP BY source)
SELECT max(s) AS best_score, min(s) AS worst_score, max(s) - min(s) AS drop_, (SELECT max(source) FROM m WHERE s >= 0.8 * (SELECT max(s) FROM m)) AS floor_tier FROM m""")
def criteria_degradation(spark, sf_dir):
    """Best and worst tier by median score, and the last tier that holds 80 percent of the best."""
    score, _, _ = sc.criteria(F.col("text"), CRITERIA)
    m = medians(spread(table(spark, sf_dir, "documents").select("source", "text")).select("source", score.alias("score")), "source", "score").select("source", F.floor("median").cast("int").alias("s"))
    best = m.agg(F.max("s").alias("best_score"), F.min("s").alias("worst_score"))
    floor_tier = m.crossJoin(F.broadcast(best)).filter("s >= 0.8 * best_score").agg(F.max("source").alias("floor_tier"))  # one row
    return best.crossJoin(floor_tier).select("best_score", "worst_score", (F.col("best_score") - F.col("worst_score")).alias("drop_"), "floor_tier")


_MET_NAMES = "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{x}{chr(39)})' for x in signals)} THEN '{name}' END" for name, signals in CRITERIA.items()) + "], lambda x: x IS NOT NULL)"


@query(f"""
WITH r AS (SELECT source AS tier, regexp_extract(source, '[0-9]+')::INT AS i, doc_id AS run, {_SCORE} AS score, {_MET_NAMES} AS met FROM documents WHERE doc_id % 6 <> 0 AND source IS NOT NULL),
m AS (SELECT tier, any_value(i) AS i, floor(quantile_cont(score, 0.5))::INT AS median FROM r GROUP BY tier),
c AS (SELECT m.*, (SELECT min(run) FROM r WHERE r.tier = m.tier AND r.score = m.median) AS run FROM m), w AS (SELECT c.*, coalesce(r.met, []) AS met FROM c LEFT JOIN r ON r.tier = c.tier AND r.run = c.run),
b AS (SELECT * FROM w ORDER BY median DESC, i LIMIT 1), z AS (SELECT * FROM w ORDER BY median, i LIMIT 1)
SELECT b.tier AS best, z.tier AS worst, b.median - z.median AS drop_, array_to_string(list_sort(list_filter(b.met, lambda x: NOT list_contains(z.met, x))), ', ') AS lost,
  (SELECT arg_max(tier, i) FROM w WHERE median >= 0.8 * (SELECT max(median) FROM w)) AS floor_tier FROM b, z""")
def tier_degradation(spark, sf_dir):
    """What the worst source costs against the best: points, the criteria lost, and the last source that keeps 80 percent. A document is a run; every sixth did not complete."""
    score, met, _ = sc.criteria(F.col("text"), CRITERIA)
    docs = spread(table(spark, sf_dir, "documents").filter("source is not null").select("doc_id", "source", "text"))
    runs = docs.select(F.col("source").alias("tier"), F.col("doc_id").alias("run"), F.when(F.col("doc_id") % 6 == 0, "failed").otherwise("completed").alias("status"), score.alias("score"), met.alias("met"))
    tiers = runs.select("tier", F.regexp_extract("tier", "[0-9]+", 0).cast("int").alias("index")).distinct()
    return rep.degradation(tiers, runs).withColumn("lost", F.array_join("lost", ", "))


_KEYS = ("the", "password", "licensed", "der", "une")


@query("SELECT doc_id, len(list_filter(%s, lambda k: contains(lower(text), k)))::INT AS matched, round_even(100.0 * len(list_filter(%s, lambda k: contains(lower(text), k))) / %d, 0)::INT AS coverage FROM documents" % ((list(_KEYS),) * 2 + (len(_KEYS),)))
def keyword_coverage(spark, sf_dir):
    n = F.size(F.filter(F.array(*map(F.lit, _KEYS)), lambda k: F.contains(F.lower(F.col("text")), k)))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("matched"), sc.percent_met(n, len(_KEYS)).alias("coverage"))


@query("SELECT doc_id FROM documents WHERE (contains(lower(text), 'the') OR contains(lower(text), 'der')) AND (contains(lower(text), 'licensed') OR contains(lower(text), 'password'))")
def keyword_groups(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(sc.all_groups(F.col("text"), (("the", "der"), ("licensed", "password")))).select("doc_id")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _any_of(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


_VAGUE = " + ".join(f"contains(lower(text), '{v}')::INT" for v in sc.VAGUE)


@query(f"""
WITH s AS (SELECT doc_id, (len(regexp_extract_all(text, {_quoted(sc.NUMBERED)})) >= 2)::INT + regexp_matches(text, {_quoted(sc.COMPONENT)})::INT + regexp_matches(text, {_quoted(sc.CONCRETE)})::INT
  + {_any_of(sc.SCOPE)}::INT + regexp_matches(text, {_quoted(sc.OWNER)})::INT AS met, {_VAGUE} AS vague FROM documents)
SELECT doc_id, greatest(0, round_even(100.0 * met / 5, 0)::INT - least(vague * 6, 30))::INT AS score, greatest(0, round_even(100.0 * met / 5, 0)::INT - least(vague * 6, 30)) >= 70 AS passed FROM s""")
def ticket_precheck(spark, sf_dir):
    score, passed = sc.ticket_score(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("score"), passed.alias("passed"))


@query(r"""
WITH f AS (SELECT doc_id, substr(text, 1, 10) AS title, substr(text, 1, 60) AS problem, substr(text, 61, 50) AS approach, substr(text, 100, 400) AS evidence, substr(text, 500, 30) AS needs, substr(text, 600) AS failures FROM documents),
m AS (SELECT doc_id, (length(trim(title)) >= 8)::INT + (length(trim(problem)) >= 40)::INT + (length(trim(approach)) >= 40)::INT + (length(trim(evidence)) >= 30 AND regexp_matches(evidence, '\d'))::INT + (length(trim(needs)) >= 20)::INT + (length(trim(failures)) >= 20)::INT AS met FROM f)
SELECT doc_id, round_even(100.0 * met / 6, 0)::INT AS score, met = 6 AS admitted FROM m""")
def contribution_gate(spark, sf_dir):
    t = lambda a, n: F.substring("text", a, n)
    score, admitted = sc.contribution(t(1, 10), t(1, 60), t(61, 50), t(100, 400), t(500, 30), F.substr("text", F.lit(600)))
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("score"), admitted.alias("admitted"))


@query()
def plan_review(spark, sf_dir):
    """Checks of plans rendered from conversations."""
    c = table(spark, sf_dir, "conversations")
    score, verdict, words = sc.plan_score(F.concat(F.lit("# Executive summary\n"), F.col("text"), F.lit("\n## Risks\nnone, see the tests\n```mermaid\n```\n")))
    return c.select("conv_id", "turn", score.alias("score"), verdict.alias("verdict"), words.alias("summary_words"))


_HAS = ", ".join(f"{_any_of(words)} AS {name}" for name, words in sc.MARKERS.items() if name != "bundle")


@query(rf"""
WITH l AS (SELECT *, string_split(text, chr(10)) AS lines FROM documents)
SELECT doc_id, {_any_of(sc.MARKERS["bundle"])} OR regexp_matches(text, '(?m)^type:\s') AS bundle, {_HAS},
  round(len(list_filter(lines, lambda x: regexp_matches(x, '^\s*(//|\*|/\*)'))) / len(lines), 6) AS comments, round(len(list_filter(lines, lambda x: regexp_matches(x, '^\s*([#>|-]|[0-9]+\.)'))) / len(lines), 6) AS structured,
  len(regexp_extract_all(text, '\]\('))::INT AS links FROM l""")
def structure_features(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in sc.structure(F.col("text")).items()))


_ENT = "{0}"
for _e, _p in tx.ENTITIES:
    _ENT = f"replace({_ENT}, '{_e}', {repr(_p) if _p != chr(39) else 'chr(39)'})"
_HTML = "html"
for _t in ("script", "style", "noscript"):
    _HTML = rf"regexp_replace({_HTML}, '(?is)<{_t}\b[^>]*>.*?</{_t}>', ' ', 'g')"
_HTML = rf"regexp_replace({_HTML}, '(?s)<!--.*?-->', ' ', 'g')"
_HTML = rf"regexp_replace({_HTML}, '(?i)</(p|div|li|h[1-6]|tr|section|article)>', chr(10), 'g')"
_HTML = _ENT.format(f"regexp_replace({_HTML}, '<[^>]+>', ' ', 'g')")
_HTML = rf"trim(regexp_replace(regexp_replace({_HTML}, '[ \t\f\v\r]+', ' ', 'g'), '\n\s*\n\s*', chr(10), 'g'), ' ')"


@query(f"SELECT page_id, {_HTML} AS body FROM pages")
def page_text(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", tx.html_text(F.col("html")).alias("body"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, left(regexp_replace(lower(html), '[^a-z0-9 ]', ' ', 'g'), 200) AS head FROM pages")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.left(F.regexp_replace(F.lower("html"), "[^a-z0-9 ]", " "), F.lit(200)).alias("head"))


@query("""
SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE text <> '') WHERE r <= 3""")
def last_n_turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf_dir, "conversations").filter("text <> ''").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, turn, len(list_filter(list_transform(regexp_extract_all(text, '[^.?!]+[.?!]'), lambda s: trim(s, ' ')), lambda s: length(s) > 1))::INT AS sentences, len(list_filter(regexp_extract_all(text, '[^.?!]+[.?!]'), lambda s: suffix(s, '?') AND length(trim(s, ' ')) > 1))::INT AS questions FROM conversations")
def questions_asked(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(tx.sentences(F.col("text"))).alias("sentences"), F.size(tx.questions(F.col("text"))).alias("questions"))


@query("SELECT role, count(*) AS turns, quantile_cont(length(text), 0.5) AS median_chars, sum(ceil(length(text) / 4.0))::BIGINT AS tokens FROM conversations GROUP BY role")
def turn_length_median(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("role", F.length("text").alias("chars"), tx.estimated_tokens(F.col("text")).alias("t"))
    sums = turns.groupBy(F.col("role").alias("of")).agg(F.count("*").alias("turns"), F.sum("t").cast("long").alias("tokens"))
    middle = medians(turns, "role", "chars")
    return sums.join(middle, F.col("of").eqNullSafe(F.col("role")), "left").select(F.col("of").alias("role"), "turns", F.col("median").alias("median_chars"), "tokens")


@query("SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_ FROM conversations")
def running_offsets(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).alias("offset_"))


@query("""
WITH r AS (SELECT *, (role <> lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn))::INT AS b FROM conversations),
g AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM r)
SELECT conv_id, run::BIGINT AS run, min(role) AS role, count(*) AS turns, min(turn) AS first_turn, max(turn) AS last_turn FROM g GROUP BY conv_id, run""")
def role_runs(spark, sf_dir):
    """Runs of consecutive turns of one role (gaps and islands)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    r = table(spark, sf_dir, "conversations").withColumn("b", (F.col("role") != F.lag("role", 1, "").over(w)).cast("int"))
    g = r.withColumn("run", F.sum("b").over(w))
    return g.groupBy("conv_id", "run").agg(F.min("role").alias("role"), F.count("*").alias("turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query(r"SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 40) || '…' ELSE text END AS shown, lower(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) AS collapsed, substr(text, 7, 66) AS body, upper(regexp_replace(left(text, 40), '[^0-9A-Fa-f]', '', 'g')) AS hex FROM documents")
def text_normal_forms(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", tx.ellipsis(t, 40).alias("shown"), F.lower(tx.collapse(t)).alias("collapsed"), F.substring(t, 7, 66).alias("body"), tx.hex_normal(F.left(t, F.lit(40))).alias("hex"))


@query("SELECT doc_id, source FROM documents ORDER BY n_chars DESC, doc_id LIMIT 12")
def longest_documents(spark, sf_dir):
    """A report of the twelve longest."""
    return table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(12).select("doc_id", "source")


@query("""
WITH good AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND lang = 'fr'), bad AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND lang = 'fr')
SELECT source, 'both' AS side FROM good INTERSECT SELECT source, 'both' FROM bad UNION ALL (SELECT source, 'good' FROM good EXCEPT SELECT source, 'good' FROM bad) UNION ALL (SELECT source, 'bad' FROM bad EXCEPT SELECT source, 'bad' FROM good)""")
def source_disagreement(spark, sf_dir):
    """Intersection and both differences of two sets of sources."""
    d = table(spark, sf_dir, "documents").filter("lang = 'fr'").join(table(spark, sf_dir, "labels"), "doc_id")
    good, bad = (d.filter(f"quality = {q}").select("source").distinct() for q in (1, 0))
    return good.intersect(bad).withColumn("side", F.lit("both")).union(good.subtract(bad).withColumn("side", F.lit("good"))).union(bad.subtract(good).withColumn("side", F.lit("bad")))
