"""Ledgers as relations: per-row rules, set equality of ids, conservation of counts, reports and resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECISIONS = ("keep", "remove_as_ui", "manual_review")
STATUSES = ("kept", "removed_as_noise", "failed", "manual_review")


def decide_image(in_body: Column, related: Column, qr: Column, in_ui: Column, decorative: Column) -> Column:
    """An image goes only on evidence that it is part of the interface; doubt about a QR code is for review."""
    content = in_body | related
    return F.when(~content & (in_ui | (~qr & decorative)), "remove_as_ui").when(qr & ~content, "manual_review").otherwise("keep")


def _errors(df: DataFrame, rules: list[tuple[Column, Column]]) -> DataFrame:
    found = F.array_compact(F.array(*(F.when(hit, text) for hit, text in rules)))
    return df.select(F.explode(found).alias("error"))


def _ids(entries: DataFrame, sources: DataFrame, what: str) -> DataFrame:
    """Duplicates, empty ids, missing and unexpected ids, one row for each."""
    say = lambda text, c="source_id": F.concat(F.lit(text), F.col(c))
    plain = entries.filter("source_id <> ''").select("source_id").distinct()
    known = sources.select("source_id").distinct()
    return (
        entries.filter("source_id <> ''").groupBy("source_id").count().filter("count > 1").select(say(f"duplicate {what} source_id: ").alias("error"))
        .union(sources.groupBy("source_id").count().filter("count > 1").select(say(f"duplicate source {what} id: ")))
        .union(entries.filter("source_id = ''").select(F.lit(f"{what} source_id must not be empty")))
        .union(sources.filter("source_id = ''").select(F.lit(f"source {what} id must not be empty")).distinct())
        .union(known.join(plain, "source_id", "left_anti").select(say(f"missing source {what} id: ")))
        .union(plain.join(known, "source_id", "left_anti").select(say(f"unexpected source {what} id: ")))
    )


def image_ledger_errors(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """entries: source_id, decision, emitted_count, reason, decoded_url, decoded_link_emitted; one row for each error."""
    c, url, reason = F.col, F.trim("decoded_url"), F.trim("reason")
    good = c("decision").isin(*DECISIONS) & (c("emitted_count") >= 0)
    gone, kept = good & (c("decision") == "remove_as_ui"), good & (c("decision") != "remove_as_ui")
    t = lambda text: F.concat(F.lit("image "), c("source_id"), F.lit(f": {text}"))
    rules = [
        (~c("decision").isin(*DECISIONS), t("unknown decision")),
        (c("decision").isin(*DECISIONS) & (c("emitted_count") < 0), t("negative emitted_count")),
        (good & c("decoded_link_emitted") & (url == ""), t("decoded link emitted without decoded_url")),
        (gone & (c("emitted_count") != 0), t("removed, yet emitted")),
        (gone & (reason == ""), t("removed without evidence")),
        (gone & c("decoded_link_emitted"), t("removed, yet its link was emitted")),
        (kept & (c("emitted_count") != 1), t("preserved, yet not emitted once")),
        (kept & (c("decision") == "manual_review") & (reason == ""), t("manual_review without a reason")),
        (kept & (url != "") & ~c("decoded_link_emitted"), t("decoded URL without a link")),
    ]
    return _errors(entries, rules).union(_ids(entries, sources, "image"))


def comment_ledger_errors(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """entries: source_id, status, emitted_count, reason; one row for each error."""
    c = F.col
    known = c("status").isin(*STATUSES)
    good = known & (c("emitted_count") >= 0)
    t = lambda text: F.concat(F.lit("comment "), c("source_id"), F.lit(f": {text}"))
    rules = [
        (~known, t("unknown status")),
        (known & (c("emitted_count") < 0), t("negative emitted_count")),
        (good & (c("status") == "kept") & (c("emitted_count") != 1), t("kept, yet not emitted once")),
        (good & (c("status") != "kept") & (c("emitted_count") != 0), t("not kept, yet emitted")),
        (good & (c("status") != "kept") & (F.trim("reason") == ""), t("not kept without a reason")),
    ]
    return _errors(entries, rules).union(_ids(entries, sources, "comment"))


def conservation(expected: DataFrame, actual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, expected, actual wherever they differ; a side without the key counts as null."""
    a = expected.unpivot(key, fields, "field", "expected")
    b = actual.unpivot(key, fields, "field", "actual")
    return a.join(b, [key, "field"], "full_outer").filter(~F.col("expected").eqNullSafe(F.col("actual")))


def report_unlocks(jobs: DataFrame, report: DataFrame, versions: dict[str, str]) -> DataFrame:
    """jobs: source_id, dom_hash, latex.  report: one row (versions, runtime_loaded, completed, katex_version, total, passed, failures, items).  The hashes that the report confirms: all of them or, where anything differs, none; with the message."""
    items = report.select(F.explode("items").alias("i")).select("i.source_id", F.col("i.dom_hash").alias("_h"), F.col("i.latex").alias("_l"))
    both = jobs.join(items, "source_id", "full_outer")
    stat = both.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count("dom_hash").alias("n_jobs"),
        F.coalesce(F.bool_and(F.col("dom_hash").isNotNull() & F.col("_h").isNotNull()), F.lit(True)).alias("same_ids"),
        F.min(F.when(F.col("dom_hash") != F.col("_h"), F.col("source_id"))).alias("bad_hash"), F.min(F.when(F.col("latex") != F.col("_l"), F.col("source_id"))).alias("bad_latex"),
    )
    r = report.crossJoin(stat)
    wrong = [(F.coalesce(F.col(k), F.lit("")) != v, F.lit(f"validation report {k} mismatch")) for k, v in versions.items()]
    wrong += [
        (~(F.coalesce("runtime_loaded", F.lit(False)) & F.coalesce("completed", F.lit(False))), F.lit("validation did not complete with a loaded runtime")),
        (F.trim(F.coalesce("katex_version", F.lit(""))) == "", F.lit("katex_version is missing")),
        (F.size("failures") > 0, F.concat(F.lit("failures: "), F.size("failures").cast("string"))),
        (F.size(F.array_distinct(F.transform("items", lambda x: x["source_id"]))) != F.size("items"), F.lit("duplicate source ids")),
        (~F.col("same_ids"), F.lit("source ids do not match the pending batch")),
        ((F.col("total") != F.col("n_jobs")) | (F.col("passed") != F.col("n_jobs")), F.lit("counts do not match the pending batch")),
        (F.col("bad_hash").isNotNull(), F.concat(F.lit("dom_hash mismatch for "), "bad_hash")),
        (F.col("bad_latex").isNotNull(), F.concat(F.lit("LaTeX mismatch for "), "bad_latex")),
    ]
    message = F.coalesce(*(F.when(hit, text) for hit, text in wrong))
    r = r.select(message.alias("message"))
    return jobs.select("dom_hash").distinct().crossJoin(F.broadcast(r)).select("dom_hash", F.col("message").isNull().alias("unlocked"), "message")


def merge_cache(cache: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The entries of new that the cache doesn't have yet."""
    return new.dropDuplicates(keys).join(cache.select(*keys), keys, "left_anti")


def fingerprint(df: DataFrame, fields: list[str]) -> DataFrame:
    """Adds fingerprint: SHA-256 of the fields as JSON with sorted keys; nulls are written."""
    return df.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256))


ARTIFACTS = ("preflight/content", "preflight/manifest", "preflight/formulas", "preflight/assets", "formula-results")


def job_digest(jobs: Column) -> Column:
    """Of an array of validation jobs, with what matters of them in a fixed order."""
    plain = F.transform(jobs, lambda j: F.struct(j["dom_hash"].alias("dom_hash"), j["latex"].alias("latex"), j["source_id"].alias("source_id"), j["source_ids"].alias("source_ids")))
    return F.sha2(F.to_json(F.struct(F.coalesce(plain, F.array()).alias("jobs"))), 256)


def artifact_ledger(artifacts: DataFrame) -> DataFrame:
    """page_id, artifacts: path, size, sha256 and schema of each artifact (page_id, path, content, schema_version)."""
    entry = F.struct("path", F.octet_length("content").cast("bigint").alias("size"), F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), "schema_version")
    return artifacts.groupBy("page_id").agg(F.array_sort(F.collect_list(entry)).alias("artifacts"))


def artifact_errors(ledger: DataFrame, artifacts: DataFrame, wanted: tuple = ARTIFACTS) -> DataFrame:
    """page_id, error: the first thing wrong with each page's artifacts, null where they all are as the ledger (page_id, artifacts) says."""
    e = ledger.select("page_id", F.explode_outer("artifacts").alias("e")).select("page_id", F.col("e.path").alias("path"), F.col("e.size").alias("size"), F.col("e.sha256").alias("sha256"), F.col("e.schema_version").alias("schema"))
    now = artifacts.select("page_id", "path", F.octet_length("content").cast("bigint").alias("_size"), F.sha2(F.col("content").cast("binary"), 256).alias("_sha"), F.col("schema_version").alias("_schema"), F.lit(True).alias("_there"))
    df = e.join(now, ["page_id", "path"], "left")
    say = lambda text: F.concat(F.lit(f"{text}: "), "path")
    unsafe = F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")
    wrong = F.coalesce(
        F.when(unsafe, say("unsafe resume artifact path")), F.when(F.col("_there").isNull(), say("resume artifact missing or unreadable")), F.when(F.col("size") != F.col("_size"), say("resume artifact size mismatch")),
        F.when(F.col("sha256") != F.col("_sha"), say("resume artifact digest mismatch")), F.when(~F.col("schema").eqNullSafe(F.col("_schema")), say("resume artifact schema mismatch")),
    )
    own = F.array_sort(F.collect_list("path"))
    s = df.groupBy("page_id").agg(own.alias("paths"), F.min(F.when(wrong.isNotNull(), F.struct("path", wrong.alias("text")))).alias("first"))
    twice = F.size(F.array_distinct("paths")) != F.size("paths")
    other = F.col("paths") != F.array(*(F.lit(x) for x in sorted(wanted)))
    return s.select("page_id", F.coalesce(F.when(twice, "resume ledger contains duplicate artifact paths"), F.when(other, "resume ledger artifact set mismatch"), F.col("first.text")).alias("error"))


def resume_eligible(jobs: Column, failures: Column, count_errors: Column, unresolved: Column) -> Column:
    """Whether a page's results may serve a later run: it has jobs, nothing failed, counts are right, and what is open is what waits for validation."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    waiting = F.array_sort(F.flatten(F.transform(jobs, lambda j: j["source_ids"])))
    return (size(jobs) > 0) & (size(failures) <= 0) & (size(count_errors) <= 0) & ((size(unresolved) <= 0) | (F.array_sort(unresolved) == waiting))


def resumable(now: DataFrame, ledger: DataFrame, key: str, errors: DataFrame | None = None) -> DataFrame:
    """key, reuse, reason: whether the last run's result stands.  now and ledger have the key and the fields of the fingerprint; the first one that differs is the reason, else what errors (key, error) says of the artifacts."""
    fields = [c for c in now.columns if c != key]
    old = ledger.select(key, *(F.col(c).alias(f"_{c}") for c in fields), F.lit(True).alias("_there"))
    df = now.join(old, key, "left")
    reason = F.when(F.col("_there").isNull(), "resume ledger does not exist")
    for c in fields:
        reason = reason.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), f"resume fingerprint mismatch: {c}")
    if errors is not None:
        df = df.join(errors.select(key, F.col("error").alias("_error")), key, "left")
        reason = reason.otherwise(F.col("_error"))
    return df.select(key, reason.isNull().alias("reuse"), reason.alias("reason"))


def collisions(packages: DataFrame) -> DataFrame:
    """output, others: outputs that several packages want (output, package)."""
    return packages.groupBy("output").agg(F.array_sort(F.collect_set("package")).alias("packages")).filter(F.size("packages") > 1)
