"""Writing and reading stored runs; reports as text."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(tables: dict[str, DataFrame], folder: str) -> None:
    """Idempotent by run: each table (run_id, …) replaces only the runs that it holds; a run written again leaves no old rows."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{folder}/{name}")


def _pointers(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(number, version) of all pointers, the newest first; one that is still being written has no version yet and is left out."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{folder}/active")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    out = []
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        if name.isdigit() and status.getLen():
            stream = fs.open(status.getPath())
            try:
                out.append((int(name), bytes(stream.readAllBytes()).decode()))
            finally:
                stream.close()
    return sorted(out, reverse=True)


def _claim(spark: SparkSession, folder: str, number: int, version: str) -> bool:
    """Makes the pointer of a number, if it does not exist: of several that try, one succeeds."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{folder}/active/{number:012d}")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where.getParent())
    content = bytearray(version.encode())
    if fs.getUri().getScheme() == "file":  # its create() looks first and creates then; a link is one step
        target = jvm.java.nio.file.Path.of(where.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
        draft = target.resolveSibling(f".{number:012d}-{uuid.uuid4().hex}")
        options = spark.sparkContext._gateway.new_array(jvm.java.nio.file.OpenOption, 0)
        jvm.java.nio.file.Files.write(draft, content, options)
        try:
            jvm.java.nio.file.Files.createLink(target, draft)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            return False
        finally:
            jvm.java.nio.file.Files.delete(draft)
        return True
    try:
        stream = fs.create(where, False)
    except Py4JJavaError as e:
        if "AlreadyExists" not in str(e.java_exception):
            raise
        return False
    try:
        stream.write(content)
    finally:
        stream.close()
    return True


def publish_corpus(tables: dict[str, DataFrame], folder: str, version: str) -> int:
    """A version's tables first, then its pointer; the pointer of the largest number names the active version. Returns the number.

    Numbers are claimed one by one: a pointer is created only if there is none of its number, else the
    next number is tried. So of publishers at the same time each gets a number of its own, and a reader
    finds the whole version before or the whole version after.
    """
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/corpus_version={version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    number = max([n for n, _ in _pointers(spark, folder)], default=0) + 1
    while not _claim(spark, folder, number, version):
        number += 1
    return number


def active_corpus(spark: SparkSession, folder: str, name: str) -> DataFrame:
    pointers = _pointers(spark, folder)
    if not pointers:
        raise ValueError(f"nothing is published in {folder}")
    return spark.read.parquet(f"{folder}/corpus_version={pointers[0][1]}/{name}")


def corpus_versions(spark: SparkSession, folder: str) -> DataFrame:
    """(number, version, active): what was published, one row a publication."""
    pointers = _pointers(spark, folder)
    return spark.createDataFrame([(n, v, i == 0) for i, (n, v) in enumerate(pointers)], "number long, version string, active boolean")


def write_eval_run(items: DataFrame, folder: str, run: str) -> None:
    """Append-only: a run that exists is an error."""
    items.write.mode("errorifexists").json(f"{folder}/{run}")


def read_eval_runs(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Items of all runs that a glob names, with the run's name from its path."""
    return spark.read.schema(schema).json(pattern).withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))


def write_run_records(records: DataFrame, folder: str) -> None:
    """(run, …, tasks): one JSON text a run, whose tasks are nested as they come; append-only, each run a line of its own."""
    records.write.mode("append").json(folder)


def run_records(spark: SparkSession, pattern: str) -> DataFrame:
    """(run, record): the records of all files that a glob names, each parsed as a variant, as their tasks differ from run to run. Lines that are no JSON have a null record."""
    text = spark.read.text(pattern)
    record = F.try_parse_json("value")
    return text.select(F.try_variant_get(record, "$.run", "string").alias("run"), record.alias("record"))


def run_metrics(records: DataFrame) -> DataFrame:
    """(run, task, metric, value) of records: every number that a task gives under metrics, whatever its name."""
    tasks = records.lateralJoin(records.sparkSession.tvf.variant_explode(F.try_variant_get(F.col("record").outer(), "$.tasks", "variant")).select(F.col("key").alias("task"), F.col("value").alias("body")))
    metrics = tasks.lateralJoin(records.sparkSession.tvf.variant_explode(F.try_variant_get(F.col("body").outer(), "$.metrics", "variant")).select(F.col("key").alias("metric"), F.col("value").alias("number")))
    return metrics.select("run", "task", "metric", F.try_variant_get("number", "$", "double").alias("value"))


def run_items(records: DataFrame) -> DataFrame:
    """(run, task, items): the items of each task grouped by their key, as a map from key to JSON texts in order."""
    spark = records.sparkSession
    tasks = records.lateralJoin(spark.tvf.variant_explode(F.try_variant_get(F.col("record").outer(), "$.tasks", "variant")).select(F.col("key").alias("task"), F.col("value").alias("body")))
    items = tasks.lateralJoin(spark.tvf.variant_explode(F.try_variant_get(F.col("body").outer(), "$.items", "variant")).select(F.col("pos"), F.col("value").alias("item")))
    each = items.select("run", "task", F.coalesce(F.try_variant_get("item", "$.key", "string"), F.lit("")).alias("key"), "pos", F.to_json("item").alias("item"))
    grouped = each.groupBy("run", "task", "key").agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("x"))
    return grouped.select("run", "task", "key", F.transform("x", lambda x: x["item"]).alias("items"))


def load_snapshots(latest: DataFrame, findings: DataFrame) -> DataFrame:
    """The latest run of each document with its findings in order of number."""
    children = findings.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("finding_no", "kind", "severity"))).alias("f"))
    joined = latest.join(children, "run_id", "left")
    return joined.select("doc_id", "run_id", F.coalesce(F.array_join(F.transform("f", lambda x: F.concat_ws(":", x["finding_no"], x["kind"], x["severity"])), ";"), F.lit("")).alias("findings"))


def compliance_report(view: DataFrame, findings: DataFrame) -> DataFrame:
    """One markdown text per document: a header, counts and a table of findings; bars in cells are escaped."""
    line = F.concat(F.lit("| "), F.col("finding_no"), F.lit(" | "), F.replace("kind", F.lit("|"), F.lit("\\|")), F.lit(" | "), F.col("severity"), F.lit(" |"))
    table = findings.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("finding_no", "standard", line.alias("line")))), lambda x: x["line"]), "\n").alias("rows"))
    head = F.concat(F.lit("# Document "), F.col("doc_id"), F.lit("\n\nOpen issues: "), F.col("open_issues"), F.lit("\n\n| No | Kind | Severity |\n| --- | --- | --- |\n"))
    return view.join(table, "run_id", "left").select("doc_id", F.concat(head, F.coalesce("rows", F.lit(""))).alias("report"))


def reassemble(latest: DataFrame, children: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """latest (doc_id, run_id, …) with an array for each kind of child: its rows of the run (run_id, …), in the order of its columns named; without any, an empty array.

    So a stored run comes back whole: requirements by place, mappings by rank, findings and repairs by
    number, evidence by finding and ordinal.
    """
    out = latest
    for name, (table, order) in children.items():
        rest = [c for c in table.columns if c not in ("run_id", *order)]
        grouped = table.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))
        out = out.join(grouped, "run_id", "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))
    return out


def _cell(text: Column) -> Column:
    """A text as a cell of a table: bars are escaped, line ends are spaces."""
    return F.replace(F.replace(F.coalesce(text.cast("string"), F.lit("—")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def _section(rows: DataFrame, by: list[str], order: list[str], line: Column, name: str, between: str = "\n") -> DataFrame:
    """The lines of each group, in order, as one text."""
    listed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))).alias("_x"))
    return listed.select(*by, F.array_join(F.transform("_x", lambda x: x["_line"]), between).alias(name))


def review_report(view: DataFrame, findings: DataFrame, evidence: DataFrame, repairs: DataFrame, mappings: DataFrame) -> DataFrame:
    """One markdown text per document of view (doc_id, run_id, requirements, standards): summary, findings with their evidence, repairs with their decision, mapping table.

    findings (run_id, finding_no, kind, severity, review, standard, reason), evidence (run_id,
    finding_no, ordinal, kind, excerpt), repairs (run_id, repair_no, decision, original, proposed,
    final), mappings (run_id, requirement, standard, basis, confidence). An accepted or edited repair
    shows the text that was adopted: the final one, else the proposed one.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    proofs = _section(evidence, ["run_id", "finding_no"], ["ordinal"], F.concat(F.lit("  - "), text("kind"), F.lit(": "), text("excerpt")), "proofs")
    shown = findings.join(proofs, ["run_id", "finding_no"], "left")
    body = F.concat(
        F.lit("### "), text("finding_no"), F.lit(". "), text("kind"), F.lit(" ("), text("severity"), F.lit(", "), text("review"), F.lit(")\n- Standard: "), text("standard"), F.lit("\n- Reason: "), text("reason"),
        F.coalesce(F.concat(F.lit("\n- Evidence:\n"), "proofs"), F.lit("")),
    )
    told = _section(shown, ["run_id"], ["finding_no"], body, "told", "\n\n")
    counts = _section(findings.groupBy("run_id", "kind").agg(F.count(F.lit(1)).alias("n")), ["run_id"], ["kind"], F.concat(F.lit("- "), text("kind"), F.lit(": "), text("n")), "counts")
    adopted = F.when(F.col("decision").isin("accepted", "edited"), F.concat(F.lit("\n- Adopted: "), F.coalesce("final", text("proposed")))).otherwise("")
    mended = _section(repairs, ["run_id"], ["repair_no"], F.concat(F.lit("### Repair "), text("repair_no"), F.lit(" ("), F.coalesce("decision", F.lit("pending")), F.lit(")\n- Original: "), text("original"), F.lit("\n- Proposed: "), text("proposed"), adopted), "mended", "\n\n")
    row = F.concat(F.lit("| "), _cell(F.col("requirement")), F.lit(" | "), _cell(F.col("standard")), F.lit(" | "), _cell(F.col("basis")), F.lit(" | "), F.coalesce(F.format_string("%.2f", "confidence"), F.lit("—")), F.lit(" |"))
    mapped = _section(mappings, ["run_id"], ["requirement", "standard"], row, "mapped")
    out = view.select("doc_id", "run_id", "requirements", "standards")
    for part in (counts, told, mended, mapped):
        out = out.join(part, "run_id", "left")
    report = F.concat(
        F.lit("# Review of document "), text("doc_id"), F.lit("\n\nRequirements: "), text("requirements"), F.lit("\nStandards: "), text("standards"),
        F.lit("\n\n## Summary\n\n"), F.coalesce("counts", F.lit("No findings.")), F.lit("\n\n## Findings\n\n"), F.coalesce("told", F.lit("None.")), F.lit("\n\n## Repairs\n\n"), F.coalesce("mended", F.lit("None.")),
        F.lit("\n\n## Requirement mapping\n\n| Requirement | Standard | Basis | Confidence |\n| --- | --- | --- | --- |\n"), F.coalesce("mapped", F.lit("")),
    )
    return out.select("doc_id", report.alias("report"))


def wire_view(df: DataFrame) -> DataFrame:
    """One JSON text per row: camel case, nulls left out."""

    def camel(name: str) -> str:
        first, *rest = name.split("_")
        return first + "".join(w.capitalize() for w in rest)

    return df.select(F.to_json(F.struct(*[F.col(c).alias(camel(c)) for c in df.columns])).alias("json"))
