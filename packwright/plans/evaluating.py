"""Queries: evaluation suites, results, resume points and pending work."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions.keys import result_name
from packwright.operators.evals import (
    look_up_metrics,
    parse_results,
    suite_scores,
    suite_table,
    suite_tasks as explode_tasks,
)
from packwright.operators.pending import RUNNING_SUFFIX, pending_results, remaining_chunks, resume_seed
from packwright.operators.shuffling import SEED
from packwright.plans.jobs import report_results
from packwright.plans.registry import query
from packwright.session import fresh_path
from packwright.sources.claims import run_pending
from packwright.sources.records import list_files, read_result_files
from packwright.sources.sinks import write_named_texts
from packwright.sources.suites import SUITES
from packwright.sources.tables import table

CHECKPOINT_PRICE = 499000
N_TASKS = sum(len(s["tasks"]) for s in SUITES.values())
TASK_ROWS = ", ".join(
    f"({number}, '{suite}', '{SUITES[suite]['metric_name']}', {SUITES[suite]['n_shots']}, '{task}')"
    for number, (suite, task) in enumerate((s, t) for s in SUITES for t in SUITES[s]["tasks"])
)
TASKS_SQL = f"tasks(task_no, suite, metric_name, n_shots, task) AS (VALUES {TASK_ROWS})"
SUITE_NAMES_SQL = ", ".join(f"('{name}')" for name in SUITES)


def _numbered_tasks(spark: SparkSession) -> DataFrame:
    """Tasks in the order of the configuration, numbered; as many rows as it has tasks."""
    order = [t for s in SUITES.values() for t in s["tasks"]]
    numbers = spark.createDataFrame(list(enumerate(order)), "task_no bigint, task string")
    return explode_tasks(suite_table(spark)).join(numbers, "task")


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as answers of a model (the language) to a task."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("model"))
    labelled = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    return labelled.withColumn("task_no", F.pmod("doc_id", F.lit(N_TASKS)))


@query(f"""
WITH {TASKS_SQL}
SELECT suite, task, metric_name, n_shots, count(doc_id)::BIGINT AS n_answers
FROM tasks LEFT JOIN documents ON doc_id % {N_TASKS} = task_no GROUP BY ALL
""")
def suite_tasks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.pmod("doc_id", F.lit(N_TASKS)).alias("task_no"))
    answers = docs.groupBy("task_no").agg(F.count("*").alias("n_answers"))
    tasks = _numbered_tasks(spark).join(answers, "task_no", "left")
    return tasks.select(
        "suite", "task", "metric_name", "n_shots", F.coalesce("n_answers", F.lit(0)).alias("n_answers")
    )


# What the result files hold: a value per model and task that has labelled answers.
RESULTS_SQL = f"""{TASKS_SQL},
a AS (
  SELECT lang AS model, suite, metric_name, task, round(avg(quality), 6) AS v
  FROM documents JOIN labels USING (doc_id) JOIN tasks ON doc_id % {N_TASKS} = task_no
  GROUP BY ALL
),
looked_up AS (
  SELECT m.model, t.suite, t.metric_name, t.task, a.v
  FROM (SELECT DISTINCT model, suite FROM a) m JOIN tasks t USING (suite)
       LEFT JOIN a ON a.model = m.model AND a.task = t.task
)"""


def _result_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON result document per model and suite; a document holds one suite's tasks."""
    answered = _answers(spark, sf).where(F.col("quality").isNotNull())
    means = answered.groupBy("model", "task_no").agg(F.round(F.avg("quality"), 6).alias("v"))
    values = means.join(F.broadcast(_numbered_tasks(spark)), "task_no")  # bounded by the configuration
    metrics = F.create_map(
        F.concat("metric_name", F.lit(",none")), F.col("v").cast("string"), F.lit("alias"), F.col("task")
    )
    entries = F.collect_list(F.struct(F.col("task"), metrics.alias("m")))
    return values.groupBy("model", "suite").agg(
        F.to_json(F.struct(F.map_from_entries(entries).alias("results"))).alias("document")
    )


def _looked_up(spark: SparkSession, sf: str) -> DataFrame:
    documents = _result_documents(spark, sf).select(
        "model", "suite", parse_results(F.col("document")).alias("results")
    )
    return look_up_metrics(documents, ["model"])


@query(f"""
WITH {RESULTS_SQL}
SELECT model, suite, task, metric_name, v AS value, v IS NULL AS missing FROM looked_up
""")
def metric_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return _looked_up(spark, sf)


@query(f"""
WITH {RESULTS_SQL},
s AS (
  SELECT model, suite, metric_name, count(*) FILTER (v IS NULL) AS n_missing, round(avg(v), 4) AS mean
  FROM looked_up GROUP BY ALL
)
SELECT model, suite, metric_name, n_missing::BIGINT AS n_missing,
       CASE WHEN n_missing = 0 THEN mean END AS metric_value,
       CASE WHEN n_missing = 0 THEN suite || ': ' || metric_name || ' = ' || mean::VARCHAR END AS report_line
FROM s
""")
def suite_report(spark: SparkSession, sf: str) -> DataFrame:
    return suite_scores(_looked_up(spark, sf), ["model"], digits=4)


@query(f"""
SELECT page_id, suite,
       CASE WHEN contains(url, 'example.com') THEN url || '/eval_' || suite || '.json'
            ELSE 'eval_' || split_part(url, '/', -1) || '_' || suite || '.json' END AS result_name
FROM pages CROSS JOIN (VALUES {SUITE_NAMES_SQL}) s(suite)
""")
def result_names(spark: SparkSession, sf: str) -> DataFrame:
    """Page addresses as model paths; those under example.com count as local folders."""
    suites = F.array(*[F.lit(name) for name in SUITES])
    rows = table(spark, sf, "pages").select("page_id", "url", F.explode(suites).alias("suite"))
    local = F.col("url").contains("example.com")
    return rows.select("page_id", "suite", result_name(F.col("url"), local, F.col("suite")).alias("result_name"))


@query(f"""
WITH planned AS (SELECT DISTINCT o_orderpriority AS run, o_orderkey // 1000 AS chunk_idx FROM orders),
done AS (SELECT o_orderpriority AS run, max(o_orderkey // 1000) AS last FROM orders WHERE o_totalprice > {CHECKPOINT_PRICE} GROUP BY ALL)
SELECT run, chunk_idx, coalesce(last, -1)::BIGINT AS last_checkpoint,
       ({SEED} + coalesce(last, -1) + 1)::BIGINT AS seed
FROM planned LEFT JOIN done USING (run) WHERE chunk_idx > coalesce(last, -1)
""")
def resume_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Runs by order priority, chunks by thousands of orders; the dearest orders stand for
    checkpoints that were written."""
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("run"), F.expr("o_orderkey div 1000").alias("chunk_idx"), "o_totalprice"
    )
    planned = rows.select("run", "chunk_idx").distinct()
    listing = rows.where(F.col("o_totalprice") > CHECKPOINT_PRICE).select(
        "run", F.concat(F.lit("runs/"), "run", F.lit("/ckpt_"), "chunk_idx").alias("path")
    )
    left = remaining_chunks(planned, listing, ["run"])
    return left.withColumn("seed", resume_seed(SEED, F.col("last_checkpoint")))


@query(f"""
WITH planned AS (
  SELECT DISTINCT source AS model, suite FROM documents CROSS JOIN (VALUES {SUITE_NAMES_SQL}) s(suite)
),
taken AS (
  SELECT DISTINCT source AS model, list_extract(
           [{", ".join(repr(n) for n in SUITES)}], (doc_id % {len(SUITES)} + 1)::INT) AS suite
  FROM documents WHERE lang IN ('de', 'fr')
)
SELECT model, suite, 'eval_' || model || '_' || suite || '.json' AS path
FROM planned ANTI JOIN taken USING (model, suite)
""")
def pending_suites(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as models. German documents stand for results, French for markers of running work."""
    names = F.array(*[F.lit(name) for name in SUITES])
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.col("source").alias("model"))
    path = result_name(F.concat(F.lit("models/"), "model"), F.lit(False), F.col("suite")).alias("path")
    planned = docs.select("model").distinct().select("model", F.explode(names).alias("suite"))
    planned = planned.select("model", "suite", path)
    suite = F.get(names, F.pmod("doc_id", F.lit(len(SUITES))).cast("int"))
    marker = F.when(F.col("lang") == "fr", ".running").otherwise("")
    taken = docs.where(F.col("lang").isin("de", "fr")).withColumn("suite", suite)
    listing = taken.select(path, "lang").distinct().select(F.concat("path", marker).alias("path"))
    return pending_results(planned, listing).select("model", "suite", "path")


@query(f"""
SELECT lang AS model, suite, count(*)::BIGINT AS n_docs, lang = 'de' AS was_there, 0::BIGINT AS n_failed_now, 0::BIGINT AS n_markers
FROM documents CROSS JOIN (VALUES {SUITE_NAMES_SQL}) s(suite) GROUP BY ALL
""")
def claimed_suites(spark: SparkSession, sf: str) -> DataFrame:
    """Languages as models, German results there already. Two workers share the rest at once;
    one suite fails at first, is free again, and is made by a second round."""
    folder = fresh_path(spark, "claimed")
    names = F.array(*[F.lit(name) for name in SUITES])
    models = table(spark, sf, "documents").groupBy(F.col("lang").alias("model")).agg(F.count("*").alias("n_docs"))
    planned = models.select("model", "n_docs", F.explode(names).alias("suite"))
    planned = planned.select("*", F.concat(F.lit("eval_"), "model", F.lit("_"), "suite", F.lit(".json")).alias("path"))
    text = F.to_json(F.struct("n_docs", (F.col("model") == "de").alias("was_there")))
    write_named_texts(planned.where("model = 'de'").select(F.col("path").alias("name"), text.alias("text")), folder)
    broken = {"eval_en_mmlu.json"}

    def make(row) -> str:
        if row.path in broken:
            broken.discard(row.path)
            raise RuntimeError("out of memory")
        return f'{{"n_docs":{row.n_docs},"was_there":false}}'

    with ThreadPoolExecutor(2) as pool:
        both = [pool.submit(run_pending, spark, planned, folder, make) for _ in range(2)]
        made = [path for worker in both for path in worker.result().made]
    if len(made) != len(set(made)):
        raise RuntimeError("two workers made the same result")
    again = run_pending(spark, planned, folder, make)
    n_markers = list_files(spark, folder).where(F.col("path").endswith(RUNNING_SUFFIX)).count()
    found = read_result_files(spark, folder).select("model", "suite", F.from_json("document", "n_docs bigint, was_there boolean").alias("d"))
    left = {"n_failed_now": len(again.failed), "n_markers": n_markers}
    return found.select("model", "suite", "d.*", *[F.lit(n).cast("bigint").alias(c) for c, n in left.items()])


@query(f"""
WITH {RESULTS_SQL},
s AS (
  SELECT model, suite, metric_name, count(*) FILTER (v IS NULL) AS n_missing, round(avg(v), 4) AS mean
  FROM looked_up GROUP BY ALL
)
SELECT model, suite, n_missing::BIGINT AS n_missing, CASE WHEN n_missing = 0 THEN mean END AS metric_value FROM s
""")
def results_per_model(spark: SparkSession, sf: str) -> DataFrame:
    """Result files of all models in one folder, read back and reported by model."""
    documents = _result_documents(spark, sf)
    folder = fresh_path(spark, "results")
    named = documents.select(F.concat_ws("_", F.lit("eval"), "model", F.concat("suite", F.lit(".json"))).alias("name"), F.col("document").alias("text"))
    write_named_texts(named, folder)
    report = report_results(spark, folder, digits=4)
    return report.select("model", "suite", "n_missing", "metric_value")


@query(f"""
WITH {RESULTS_SQL},
s AS (
  SELECT model, suite, metric_name, count(*) FILTER (v IS NULL) AS n_missing, round(avg(v), 4) AS mean
  FROM looked_up GROUP BY ALL
)
SELECT model, suite, n_missing::BIGINT AS n_missing, CASE WHEN n_missing = 0 THEN mean END AS metric_value FROM s
""")
def results_in_folders(spark: SparkSession, sf: str) -> DataFrame:
    """A folder per model, a file per suite, its tasks inside groups; read back as one source."""
    results = F.from_json("document", "results map<string, map<string, string>>")["results"]
    grouped = F.transform(
        F.sequence(F.lit(0), F.lit(2)),
        lambda g: F.struct(F.concat(F.lit("group_"), g), F.map_filter(results, lambda task, _: F.length(task) % 3 == g)),
    )
    nested = F.to_json(F.struct(F.map_from_entries(grouped).alias("results")))
    folder = fresh_path(spark, "results")
    name = F.concat("model", F.lit("/eval_"), "suite", F.lit(".json"))
    write_named_texts(_result_documents(spark, sf).select(name.alias("name"), nested.alias("text")), folder)
    return report_results(spark, folder, digits=4).select("model", "suite", "n_missing", "metric_value")


@query("""
WITH done AS (SELECT lang AS model, count(*) // 50 AS last, count(*) // 40 AS planned FROM documents GROUP BY lang)
SELECT model, chunk_idx::BIGINT AS chunk_idx, last::BIGINT AS last_checkpoint
FROM (SELECT *, unnest(range(0, planned + 1)) AS chunk_idx FROM done) WHERE chunk_idx > last
""")
def remaining_work(spark: SparkSession, sf: str) -> DataFrame:
    """A run per language has its checkpoint folders listed; the chunks it still has to do."""
    docs = table(spark, sf, "documents").groupBy(F.col("lang").alias("model")).agg(F.count("*").alias("n"))
    root = fresh_path(spark, "runs")
    last = F.expr("n div 50")
    write_named_texts(docs.select(F.concat("model", F.lit("/ckpt_"), last, F.lit("/state")).alias("name"), F.lit("x").alias("text")), root)
    manifest = list_files(spark, root).select(F.regexp_extract("path", r"/([^/]+)/ckpt_\d+$", 1).alias("model"), "path")
    planned = docs.select("model", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("n div 40"))).alias("chunk_idx"))
    remaining = remaining_chunks(planned, manifest.where("model <> ''"), ["model"])
    return remaining.select("model", "chunk_idx", "last_checkpoint")
