"""Queries on records, sampling, reviews, graphs, answers and suites."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.operators.graphs import ancestors, children, descendants, graph_issues, ladder_gaps, levels, ready
from granary.operators.learning import answer_form, answer_matches, bucket, forgetting_risk, largest_remainder, node_coverage, pick, review_state
from granary.queries import query, table
from granary.queries.storage import folder
from granary.sources.files import read_graph

_B = "('0x' || substr(sha256('20261005:' || doc_id), 1, 8))::BIGINT % 10000"


@query(f"SELECT doc_id, {_B} AS bucket, CASE WHEN {_B} < 1000 THEN 'val' ELSE 'train' END AS split FROM documents")
def record_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's bucket and split by a hash of its id."""
    b = bucket(F.col("doc_id").cast("string"), 20261005)
    return table(spark, sf_dir, "documents").select("doc_id", b.alias("bucket"), F.when(b < 1000, "val").otherwise("train").alias("split"))


@query("SELECT first_doc, last_doc, copies FROM (SELECT sha256(text) AS h, min(doc_id) AS first_doc, max(doc_id) AS last_doc, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1) WHERE copies > 1")
def record_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last record of each content that occurs again."""
    x = table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("h"))
    return x.agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("copies")).where("copies > 1").drop("h")


@query("SELECT route, count(*) AS records FROM (SELECT CASE WHEN license IS NULL THEN 'rejected' WHEN NOT coalesce(license_verified, false) THEN 'quarantine' ELSE 'trainable' END AS route FROM (SELECT DISTINCT doc_id, license, license_verified FROM split_stream)) GROUP BY 1")
def record_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by where their licence sends them."""
    x = table(spark, sf_dir, "split_stream").select("doc_id", "license", "license_verified").distinct()
    return x.groupBy(F.when(F.col("license").isNull(), "rejected").when(~F.coalesce("license_verified", F.lit(False)), "quarantine").otherwise("trainable").alias("route")).agg(F.count("*").alias("records"))


@query("WITH w AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), e AS (SELECT source, n * 500.0::DOUBLE / sum(n) OVER () AS x FROM w), f AS (SELECT source, floor(x) AS f, round(x - floor(x), 9) AS r FROM e) SELECT source, (f + CASE WHEN row_number() OVER (ORDER BY r DESC, source) <= 500 - sum(f) OVER () THEN 1 ELSE 0 END)::BIGINT AS share FROM f")
def sample_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 places dealt to the sources by their documents, largest remainders last."""
    x = table(spark, sf_dir, "documents").where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n"))
    return largest_remainder(x, "source", "n", 500).select("source", "share")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || doc_id), doc_id) AS n FROM documents WHERE source IS NOT NULL) WHERE n <= 5")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents of each source in the order of a seeded hash."""
    return pick(table(spark, sf_dir, "documents").where("source IS NOT NULL"), ["source"], "doc_id", 5, 7).select("source", "doc_id")


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND value IS NOT NULL")
    return e.select("user_id", F.datediff(F.to_date("ts"), F.lit("1970-01-01")).alias("day"), F.pmod(F.col("value"), F.lit(1.0)).alias("p"), "event_id")


_DAILY = "SELECT user_id, date_diff('day', DATE '1970-01-01', ts::DATE) AS d, avg(value % 1) AS p FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2"
_UP = "CASE WHEN q.p >= 0.8 THEN least(r.stage + 1, 6) WHEN q.p < 0.5 THEN greatest(r.stage - 2, 0) ELSE r.stage END"
_FOLD = f"""WITH RECURSIVE q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d) AS i FROM ({_DAILY})),
 r(user_id, i, stage, due_day) AS (SELECT DISTINCT user_id, 0::BIGINT, 0, NULL::BIGINT FROM q UNION ALL SELECT q.user_id, q.i, {_UP}, q.d + [1, 3, 7, 16, 35, 75, 160][{_UP} + 1] FROM r JOIN q ON q.user_id = r.user_id AND q.i = r.i + 1),
 s AS (SELECT user_id, arg_max(stage, i) AS stage, arg_max(due_day, i)::INT AS due_day, max(i)::INT AS reviews FROM r GROUP BY 1) """


@query(_FOLD + "SELECT user_id, due_day, stage FROM s WHERE due_day <= (SELECT median(due_day) FROM s) ORDER BY due_day, user_id")
def due_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys due by the median due day, the earliest first."""
    s = review_state(_reviews(spark, sf_dir), "user_id", "day", "p")
    today = s.agg(F.median("due_day").alias("today"))
    return s.join(F.broadcast(today), F.col("due_day") <= F.col("today")).select("user_id", "due_day", "stage").orderBy("due_day", "user_id")


@query(_FOLD + "SELECT stage, count(*) AS keys, round(avg(due_day), 4) AS mean_due, sum(reviews)::BIGINT AS reviews FROM s GROUP BY 1")
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys at each stage, when they fall due on average, and their reviews."""
    s = review_state(_reviews(spark, sf_dir), "user_id", "day", "p")
    return s.groupBy("stage").agg(F.count("*").alias("keys"), F.round(F.avg("due_day"), 4).alias("mean_due"), F.sum("reviews").alias("reviews"))


@query(_FOLD + "SELECT user_id, stage, due_day, reviews FROM s")
def review_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage and due day of each key after its reviews, folded in order."""
    return review_state(_reviews(spark, sf_dir), "user_id", "day", "p")


@query("WITH d AS (SELECT user_id, date_diff('day', DATE '1970-01-01', ts::DATE) AS day FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL), l AS (SELECT user_id, max(day) AS last FROM d GROUP BY 1), m AS (SELECT max(last) AS today FROM l) SELECT user_id, last, round(least(1.0, 0.5 * (today - last) / 7 + 0.5 * greatest(0.0, (today - last - 7) / 7.0::DOUBLE)), 6) AS risk FROM l, m")
def forgetting_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely each key's matter is forgotten on the last day, at an interval of a week."""
    last = _reviews(spark, sf_dir).groupBy("user_id").agg(F.max("day").alias("last"))
    today = last.agg(F.max("last").alias("today"))
    return last.join(F.broadcast(today)).select("user_id", "last", F.round(forgetting_risk(F.col("today"), F.col("last"), F.lit(7)), 6).alias("risk"))


_N = "n AS MATERIALIZED (SELECT node, split_part(node, '.', 1) AS subject, substr(split_part(node, '.', 2), 2)::INT AS grade FROM (SELECT DISTINCT curriculum_node AS node FROM dev_smoke_suite WHERE regexp_matches(curriculum_node, '^[a-z]+[.]g[0-9]+$')))"
_E = f"""{_N}, e AS MATERIALIZED (SELECT node, lag(node) OVER (PARTITION BY subject ORDER BY grade) AS needs FROM n UNION SELECT a.node, b.node FROM n a JOIN n b ON b.grade = a.grade - 1 AND a.subject = 'reas' AND b.subject = 'math'
 UNION SELECT a.node, b.node FROM n a JOIN n b ON b.grade = a.grade + 6 AND a.subject = 'hind' AND b.subject = 'lang' UNION SELECT node, 'math.g00' FROM n WHERE grade = 9)"""
_R = "r(node, ancestor) AS (SELECT node, needs FROM e WHERE needs IS NOT NULL UNION SELECT r.node, e.needs FROM r JOIN e ON e.node = r.ancestor WHERE e.needs IS NOT NULL)"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the suite's cases: a subject and a grade each."""
    x = table(spark, sf_dir, "dev_smoke_suite").select(F.col("curriculum_node").alias("node")).where(F.col("node").rlike("^[a-z]+[.]g[0-9]+$")).distinct()
    return x.select("node", F.split("node", "[.]")[0].alias("subject"), F.substring(F.split("node", "[.]")[1], 2, 9).cast("int").alias("grade"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node needs the one before it in its subject; some need nodes of other subjects, of higher grades, or none that is known."""
    n = _nodes(spark, sf_dir)
    before = n.select("node", F.lag("node").over(Window.partitionBy("subject").orderBy("grade")).alias("needs"))
    pair = lambda a, b, by: n.where(F.col("subject") == a).select("node", (F.col("grade") + by).alias("grade")).join(n.where(F.col("subject") == b).select(F.col("node").alias("needs"), "grade"), "grade").select("node", "needs")
    return before.union(pair("reas", "math", -1)).union(pair("hind", "lang", 6)).union(n.where("grade = 9").select("node", F.lit("math.g00"))).distinct()


@query(f"WITH RECURSIVE {_E}, {_R} SELECT node, ancestor FROM r")
def graph_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that each node depends on."""
    return ancestors(_edges(spark, sf_dir))


@query(f"WITH {_E} SELECT e.node, subject, grade, e.needs FROM e JOIN n ON n.node = e.node WHERE needs IS NOT NULL")
def graph_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph written as YAML and read again, each edge with its node's subject and grade."""
    out = f"{folder(spark)}/graph"
    needs = _edges(spark, sf_dir).where("needs IS NOT NULL").groupBy("node").agg(F.collect_list("needs").alias("depends_on"))
    n = _nodes(spark, sf_dir).join(needs, "node", "left").select(F.struct(F.col("node").alias("id"), "subject", "grade", "depends_on").alias("n"))
    n.agg(F.to_json(F.struct(F.collect_list("n").alias("nodes"))).alias("value")).coalesce(1).write.text(out)
    nodes, edges = read_graph(spark, out)
    return edges.join(nodes, "node").select("node", "subject", "grade", "needs")


@query(f"WITH RECURSIVE {_E}, {_R} SELECT ancestor AS node, node AS descendant FROM r")
def graph_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that depends on each node."""
    return descendants(_edges(spark, sf_dir))


@query(f"WITH {_E} SELECT needs AS node, count(*) AS children, min(node) AS first_child FROM e WHERE needs IS NOT NULL GROUP BY 1")
def graph_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes need a node at once, and the first of them."""
    return children(_edges(spark, sf_dir)).groupBy("node").agg(F.count("*").alias("children"), F.min("child").alias("first_child"))


@query(f"WITH RECURSIVE {_E}, k AS (SELECT e.node, e.needs FROM e JOIN n ON n.node = e.needs), l(node, level) AS (SELECT node, 0 FROM n WHERE node NOT IN (SELECT node FROM k) UNION SELECT k.node, l.level + 1 FROM l JOIN k ON k.needs = l.node) SELECT node, max(level) AS level FROM l GROUP BY 1")
def graph_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of each node: the longest way from one without needs."""
    return levels(_nodes(spark, sf_dir), _edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {_E}, {_R} SELECT DISTINCT e.node, 'unknown_dependency' AS code, needs AS other FROM e WHERE needs IS NOT NULL AND needs NOT IN (SELECT node FROM n)
 UNION ALL SELECT DISTINCT e.node, 'forward_dependency', needs FROM e JOIN n a ON a.node = e.node JOIN n b ON b.node = e.needs WHERE b.grade > a.grade
 UNION ALL SELECT node, 'orphan', NULL FROM n WHERE node NOT IN (SELECT node FROM e WHERE needs IS NOT NULL) AND node NOT IN (SELECT needs FROM e WHERE needs IS NOT NULL)
 UNION ALL SELECT DISTINCT node, 'cycle', NULL FROM r WHERE node = ancestor""")
def graph_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown needs, needs of a higher grade, nodes by themselves, nodes on a cycle."""
    return graph_issues(_nodes(spark, sf_dir), _edges(spark, sf_dir), "grade")


_STARTED = "s AS (SELECT curriculum_node AS node FROM dev_smoke_suite GROUP BY 1 HAVING count(*) > 1)"


@query(f"WITH {_E}, {_STARTED} SELECT node FROM n WHERE node NOT IN (SELECT node FROM s WHERE node IS NOT NULL) AND node NOT IN (SELECT node FROM e WHERE needs IS NOT NULL AND needs NOT IN (SELECT node FROM s WHERE node IS NOT NULL))")
def ready_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes not yet started of which all needs are started (more than one case)."""
    started = table(spark, sf_dir, "dev_smoke_suite").where("curriculum_node IS NOT NULL").groupBy(F.col("curriculum_node").alias("node")).agg(F.count("*").alias("n")).where("n > 1").select("node")
    return ready(_nodes(spark, sf_dir), _edges(spark, sf_dir), started)


@query(f"WITH {_E}, {_STARTED} SELECT node, 'started' AS state FROM s WHERE node IN (SELECT node FROM n) UNION ALL SELECT node, 'ready' FROM n WHERE node NOT IN (SELECT node FROM s WHERE node IS NOT NULL) AND node NOT IN (SELECT node FROM e WHERE needs IS NOT NULL AND needs NOT IN (SELECT node FROM s WHERE node IS NOT NULL))")
def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes in play: those started, and those ready."""
    n = _nodes(spark, sf_dir)
    started = table(spark, sf_dir, "dev_smoke_suite").where("curriculum_node IS NOT NULL").groupBy(F.col("curriculum_node").alias("node")).agg(F.count("*").alias("n")).where("n > 1").select("node")
    both = started.join(n.select("node"), "node", "left_semi").select("node", F.lit("started").alias("state"))
    return both.unionByName(ready(n, _edges(spark, sf_dir), started).select("node", F.lit("ready").alias("state")))


@query(f"WITH {_N} SELECT n.subject, count(DISTINCT n.node) AS nodes, min(grade) AS lowest, max(grade) AS highest, array_to_string(list_sort(list_distinct(flatten(list(coalesce(tags, []))))), ',') AS topics FROM n JOIN dev_smoke_suite d ON d.curriculum_node = n.node GROUP BY 1")
def subject_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, grades and topics (tags of cases) of each subject."""
    tags = table(spark, sf_dir, "dev_smoke_suite").select(F.col("curriculum_node").alias("node"), "tags")
    x = _nodes(spark, sf_dir).join(tags, "node").groupBy("subject")
    topics = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("tags", F.array().cast("array<string>")))))), ",")
    return x.agg(F.count_distinct("node").alias("nodes"), F.min("grade").alias("lowest"), F.max("grade").alias("highest"), topics.alias("topics"))


@query(f"WITH {_N} SELECT * FROM (SELECT subject, grade, lag(grade) OVER (PARTITION BY subject ORDER BY grade) AS before FROM n) WHERE before IS NOT NULL AND grade > before + 1")
def ladder_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades that a subject's ladder leaves out."""
    return ladder_gaps(_nodes(spark, sf_dir).select("subject", "grade"), "subject", "grade")


@query(f"WITH {_E}, c AS (SELECT node, subject, lag(node) OVER (PARTITION BY subject ORDER BY grade DESC) AS after FROM n) SELECT c.after AS node, c.node AS before, EXISTS (SELECT 1 FROM e WHERE e.node = c.after AND e.needs = c.node) AS tied FROM c WHERE c.after IS NOT NULL")
def chain_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each step of a subject's chain needs the step before it."""
    n = _nodes(spark, sf_dir)
    steps = n.select("node", F.lag("node").over(Window.partitionBy("subject").orderBy("grade")).alias("before")).where("before IS NOT NULL")
    tied = _edges(spark, sf_dir).select("node", F.col("needs").alias("before"), F.lit(True).alias("t"))
    return steps.join(tied, ["node", "before"], "left").select("node", "before", F.coalesce("t", F.lit(False)).alias("tied"))


@query("SELECT case_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(expected), '[\\t-\\r \\x{85}\\x{200b}\\p{Z}]+', ' ', 'g'), '^ +| +$', '', 'g'), '[।.,;:!?\"''`]+$', ''), '^ +| +$', '', 'g') AS form, len(accepted) AS accepted FROM dev_smoke_suite WHERE expected IS NOT NULL")
def answer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected answers in comparable form."""
    return table(spark, sf_dir, "dev_smoke_suite").where("expected IS NOT NULL").select("case_id", answer_form(F.col("expected")).alias("form"), F.size("accepted").alias("accepted"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "dev_smoke_suite")
    mode = F.when(F.col("verification").isin("exact", "numeric", "set"), F.col("verification")).otherwise("exact")
    unknown = F.conv(F.substring(F.md5("case_id"), 1, 4), 16, 10).cast("int") % 3 == 0
    answer = F.when(unknown, F.lit("unknown")).otherwise(F.col("expected"))
    every = F.coalesce(F.concat(F.array("expected"), F.coalesce("accepted", F.array().cast("array<string>"))), F.array("expected"))
    ok = F.exists(F.filter(every, lambda x: x.isNotNull()), lambda x: F.coalesce(answer_matches(answer, x, mode, F.col("tolerance")), F.lit(False)))
    return c.select("case_id", "axis", "subject", F.when(F.col("expected").isNull(), "unscored").when(ok, "pass").otherwise("fail").alias("status"))


_SCORED = """SELECT case_id, axis, subject, verification, CASE WHEN expected IS NULL THEN 'unscored' WHEN ('0x' || substr(md5(case_id), 1, 4))::INT % 3 = 0 THEN 'fail'
 WHEN verification = 'numeric' AND NOT regexp_matches(expected, '[0-9]') THEN 'fail' ELSE 'pass' END AS status FROM dev_smoke_suite"""


@query(f"SELECT case_id, axis, subject, status FROM ({_SCORED})")
def suite_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case's result for a stand-in that knows two answers in three."""
    return _scored(spark, sf_dir)


@query(f"SELECT count(*) AS cases, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'fail') AS failed, bool_and(status = 'unscored' OR verification IN ('exact', 'numeric', 'set')) AS verified_evidence, round(count(*) FILTER (status = 'pass') / count(*) FILTER (status <> 'unscored')::DOUBLE, 4) AS score FROM ({_SCORED})")
def suite_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases, passes and failures, and whether every scored case was checked by a rule."""
    v = table(spark, sf_dir, "dev_smoke_suite").select("case_id", "verification")
    x = _scored(spark, sf_dir).join(v, "case_id")
    ok = F.bool_and((F.col("status") == "unscored") | F.col("verification").isin("exact", "numeric", "set"))
    passed, failed = F.count_if(F.col("status") == "pass"), F.count_if(F.col("status") == "fail")
    return x.agg(F.count("*").alias("cases"), passed.alias("passed"), failed.alias("failed"), ok.alias("verified_evidence"), F.round(F.try_divide(passed, passed + failed), 4).alias("score"))


@query(f"SELECT axis, count(*) AS cases, count(*) FILTER (status <> 'unscored') AS scored, count(*) FILTER (status = 'pass') AS passed, CASE WHEN count(*) FILTER (status <> 'unscored') > 0 THEN round(count(*) FILTER (status = 'pass') / count(*) FILTER (status <> 'unscored')::DOUBLE, 4) END AS score FROM ({_SCORED}) GROUP BY 1")
def suite_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases, passes and score per axis; no score where nothing was scored."""
    x = _scored(spark, sf_dir).groupBy("axis").agg(F.count("*").alias("cases"), F.count_if(F.col("status") != "unscored").alias("scored"), F.count_if(F.col("status") == "pass").alias("passed"))
    return x.withColumn("score", F.round(F.try_divide("passed", "scored"), 4))


_RUN = "SELECT event_type AS axis, round(avg(value), 9) AS score FROM events WHERE {} GROUP BY 1"


@query(f"WITH b AS ({_RUN.format('event_id % 2 = 0')}), c AS ({_RUN.format('event_id % 2 = 1')}) SELECT coalesce(b.axis, c.axis) AS axis, round(c.score - b.score, 6) AS delta, CASE WHEN c.score IS NULL THEN 'missing' WHEN b.score IS NULL THEN 'new' WHEN c.score < b.score - 0.02 THEN 'regressed' WHEN c.score > b.score + 0.02 THEN 'improved' ELSE 'stable' END AS verdict FROM b FULL JOIN c ON b.axis = c.axis")
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' scores per axis against each other (full join), within a tolerance."""
    e = table(spark, sf_dir, "events")
    run = lambda c, n: e.where(c).groupBy(F.col("event_type").alias("axis")).agg(F.round(F.avg("value"), 9).alias(n))
    x = run("event_id % 2 = 0", "b").join(run("event_id % 2 = 1", "c"), "axis", "full")
    verdict = F.when(F.col("c").isNull(), "missing").when(F.col("b").isNull(), "new").when(F.col("c") < F.col("b") - 0.02, "regressed").when(F.col("c") > F.col("b") + 0.02, "improved").otherwise("stable")
    return x.select("axis", F.round(F.col("c") - F.col("b"), 6).alias("delta"), verdict.alias("verdict"))


@query("SELECT event_type AS lang, count(*) AS docs, sum(tok)::BIGINT AS tokens, round(exp(least(80, sum(nll * tok) / sum(tok))), 6) AS perplexity, round(median(nll), 6) AS median_nll FROM (SELECT event_type, abs(value) % 10 AS nll, event_id % 97 + 1 AS tok FROM events WHERE value IS NOT NULL) GROUP BY 1")
def perplexity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-weighted perplexity, capped, and the median per slice."""
    x = table(spark, sf_dir, "events").where("value IS NOT NULL").select(F.col("event_type").alias("lang"), (F.abs("value") % 10).alias("nll"), (F.col("event_id") % 97 + 1).alias("tok"))
    return x.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("tok").alias("tokens"), F.round(F.exp(F.least(F.lit(80.0), F.sum(F.col("nll") * F.col("tok")) / F.sum("tok"))), 6).alias("perplexity"), F.round(F.median("nll"), 6).alias("median_nll"))


@query("SELECT user_id, count(*) AS attempts, round(avg(p), 4) AS accuracy, CASE WHEN count(*) = 0 THEN 'not_started' WHEN count(*) < 3 THEN 'learning' WHEN count(*) >= 8 AND round(avg(p), 4) >= 0.8 THEN 'assessed' ELSE 'practice' END AS state FROM (SELECT user_id, CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END AS p FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL) GROUP BY 1")
def coverage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each key has come, by attempts and accuracy."""
    x = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND value IS NOT NULL").select("user_id", F.when(F.col("value") >= 50, 1.0).otherwise(0.0).alias("p"))
    x = x.groupBy("user_id").agg(F.count("*").alias("attempts"), F.round(F.avg("p"), 4).alias("accuracy"))
    return x.withColumn("state", F.when(F.col("attempts") < 3, "learning").when((F.col("attempts") >= 8) & (F.col("accuracy") >= 0.8), "assessed").otherwise("practice"))


@query("SELECT r.request, count(DISTINCT answer) AS answers, count(*) AS drafts, CASE WHEN count(*) < 2 THEN 'insufficient' WHEN count(DISTINCT answer) = 1 THEN 'agreed' ELSE 'disagreement' END AS outcome FROM (SELECT user_id AS request, event_type AS answer FROM events WHERE user_id IS NOT NULL) r GROUP BY 1")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the drafts of a request agree."""
    x = table(spark, sf_dir, "events").where("user_id IS NOT NULL").groupBy(F.col("user_id").alias("request")).agg(F.count_distinct("event_type").alias("answers"), F.count("*").alias("drafts"))
    return x.withColumn("outcome", F.when(F.col("drafts") < 2, "insufficient").when(F.col("answers") == 1, "agreed").otherwise("disagreement"))


@query("SELECT lang, count(*) FILTER (license IS NOT NULL) AS licensed, count(*) FILTER (license IS NULL) AS unlicensed FROM documents GROUP BY lang")
def label_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with and without a licence per label, zeros filled in (pivot)."""
    x = table(spark, sf_dir, "documents").withColumn("k", F.when(F.col("license").isNull(), "unlicensed").otherwise("licensed"))
    return x.groupBy("lang").pivot("k", ["licensed", "unlicensed"]).count().na.fill(0, ["licensed", "unlicensed"])


@query(f"SELECT sha256(string_agg(h, chr(10) ORDER BY h)) AS suite_hash, count(*) AS cases FROM (SELECT sha256(case_id || '|' || prompt || '|' || coalesce(expected, '')) AS h FROM dev_smoke_suite)")
def suite_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash of a suite's cases, whatever their order."""
    h = F.sha2(F.concat_ws("|", "case_id", "prompt", F.coalesce("expected", F.lit(""))), 256)
    return table(spark, sf_dir, "dev_smoke_suite").select(h.alias("h")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("suite_hash"), F.count("*").alias("cases"))


@query("SELECT axis, subject, case_id FROM (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY sha256('11:' || case_id), case_id) AS n FROM dev_smoke_suite) WHERE n <= 3")
def suite_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three cases of each axis in the order of a seeded hash."""
    return pick(table(spark, sf_dir, "dev_smoke_suite"), ["axis"], "case_id", 3, 11).select("axis", "subject", "case_id")



_ASSESSED = """SELECT user_id AS node, CASE event_type WHEN 'purchase' THEN 'transfer' WHEN 'error' THEN 'verification' ELSE 'quiz' END AS kind, (value >= 8)::INT AS correct, 1 AS total,
 CASE WHEN value < 5 THEN 'beginner' WHEN value < 20 THEN 'elementary' WHEN value < 40 THEN 'intermediate' WHEN value < 60 THEN 'advanced' END AS difficulty, event_id % 40 = 0 AS verified FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL AND event_id % 9 = user_id % 9"""
_COVERED = f"""WITH a AS ({_ASSESSED}), g AS (SELECT node, count(*) AS attempts, sum(total)::BIGINT AS total, sum(correct)::BIGINT AS correct, sum(correct) / sum(total)::DOUBLE AS accuracy,
 max(CASE difficulty WHEN 'beginner' THEN 0 WHEN 'elementary' THEN 1 WHEN 'intermediate' THEN 2 WHEN 'advanced' THEN 3 WHEN 'expert' THEN 4 WHEN 'olympiad' THEN 5 ELSE -1 END) AS d, count(*) FILTER (verified) AS verified,
 bool_or(kind = 'transfer') AS t, bool_or(kind = 'verification') AS v FROM a GROUP BY 1),
 b AS (SELECT *, CASE WHEN attempts < 3 THEN ['too_little_evidence'] ELSE list_filter([CASE WHEN attempts < 8 THEN 'few_attempts' END, CASE WHEN accuracy < 0.8 THEN 'low_accuracy' END, CASE WHEN d < 2 THEN 'low_difficulty' END, CASE WHEN NOT t THEN 'no_transfer' END, CASE WHEN NOT v THEN 'no_verification' END, CASE WHEN verified = 0 THEN 'nothing_verified' END], lambda x: x IS NOT NULL) END AS blockers FROM g),
 s AS (SELECT *, CASE WHEN attempts < 3 THEN 'learning' WHEN len(blockers) = 0 THEN 'mastered' WHEN attempts >= 8 AND accuracy >= 0.8 THEN 'assessed' ELSE 'practice' END AS state FROM b) """


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND value IS NOT NULL AND event_id % 9 = user_id % 9")
    kind = F.when(F.col("event_type") == "purchase", "transfer").when(F.col("event_type") == "error", "verification").otherwise("quiz")
    difficulty = F.when(F.col("value") < 5, "beginner").when(F.col("value") < 20, "elementary").when(F.col("value") < 40, "intermediate").when(F.col("value") < 60, "advanced")
    x = e.select(F.col("user_id").alias("node"), kind.alias("kind"), (F.col("value") >= 8).cast("int").alias("correct"), F.lit(1).alias("total"), difficulty.alias("difficulty"), (F.col("event_id") % 40 == 0).alias("verified"))
    return node_coverage(x, "node", "kind", "correct", "total", "difficulty", "verified")


@query(_COVERED + "SELECT node, attempts, total, correct, round(accuracy, 6) AS accuracy, CASE d WHEN 0 THEN 'beginner' WHEN 1 THEN 'elementary' WHEN 2 THEN 'intermediate' WHEN 3 THEN 'advanced' WHEN 4 THEN 'expert' WHEN 5 THEN 'olympiad' ELSE 'none' END AS difficulty, verified, array_to_string(blockers, ',') AS blockers, state FROM s")
def node_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the assessments of each node show, what stands against mastery, and its state."""
    return _covered(spark, sf_dir).withColumn("accuracy", F.round("accuracy", 6)).withColumn("blockers", F.array_join("blockers", ","))


@query(_COVERED + "SELECT node % 5 AS subject, count(*) FILTER (state = 'learning') AS learning, count(*) FILTER (state = 'practice') AS practice, count(*) FILTER (state = 'assessed') AS assessed, count(*) FILTER (state = 'mastered') AS mastered FROM s GROUP BY 1")
def states_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes in each state per subject, zeros filled in (pivot)."""
    states = ["learning", "practice", "assessed", "mastered"]
    return _covered(spark, sf_dir).groupBy((F.col("node") % 5).alias("subject")).pivot("state", states).count().na.fill(0, states)


@query(f"WITH RECURSIVE {_E}, k AS (SELECT e.node, e.needs FROM e JOIN n ON n.node = e.needs), l(node, level) AS (SELECT node, 0 FROM n WHERE node NOT IN (SELECT node FROM k) UNION SELECT k.node, l.level + 1 FROM l JOIN k ON k.needs = l.node) SELECT node, row_number() OVER (ORDER BY level, node) AS place FROM (SELECT node, max(level) AS level FROM l GROUP BY 1)")
def graph_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order of the nodes in which each comes after all that it needs; nodes of a level by name."""
    x = levels(_nodes(spark, sf_dir), _edges(spark, sf_dir)).where("level IS NOT NULL")
    return x.select("node", F.row_number().over(Window.orderBy("level", "node")).cast("bigint").alias("place"))


@query("SELECT case_id, CASE WHEN answered AND expected IS NOT NULL THEN 'answered' WHEN expected IS NULL THEN 'unscored' ELSE 'missing' END AS state, coalesce(len(accepted), 0) + CASE WHEN expected IS NULL THEN 0 ELSE 1 END AS tries FROM (SELECT *, ('0x' || substr(md5(case_id), 1, 2))::INT % 2 = 0 AS answered FROM dev_smoke_suite)")
def answer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with an answer, without one (which counts as empty), and those that nothing is expected of; and how many answers are tried."""
    c = table(spark, sf_dir, "dev_smoke_suite")
    answers = c.where(F.conv(F.substring(F.md5("case_id"), 1, 2), 16, 10).cast("int") % 2 == 0).select("case_id", F.lit(True).alias("a"))
    x = c.join(answers, "case_id", "left")
    state = F.when(F.col("a") & F.col("expected").isNotNull(), "answered").when(F.col("expected").isNull(), "unscored").otherwise("missing")
    return x.select("case_id", state.alias("state"), (F.coalesce(F.size("accepted"), F.lit(0)) + F.col("expected").isNotNull().cast("int")).cast("bigint").alias("tries"))


@query(f"WITH b AS ({_RUN.format('event_id % 2 = 0')}), c AS ({_RUN.format('event_id % 2 = 1')}) SELECT CASE WHEN c.score < b.score - 0.02 THEN 'regressed' WHEN c.score > b.score + 0.02 THEN 'improved' ELSE 'stable' END AS verdict, count(*) AS axes, string_agg(b.axis, ',' ORDER BY b.axis) AS names FROM b JOIN c USING (axis) GROUP BY 1")
def axes_by_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes of two runs by how they changed."""
    x = run_comparison(spark, sf_dir).where("verdict IN ('regressed', 'improved', 'stable')")
    return x.groupBy("verdict").agg(F.count("*").alias("axes"), F.array_join(F.array_sort(F.collect_list("axis")), ",").alias("names"))
