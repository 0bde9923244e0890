"""Package checks: each gives ``(path, check, ok, details)``; joins over parts, relationships and nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.package import P, R, W, attr, content_types, relationships, resolve

# What a package must hold.
WORD_PARTS = ("[Content_Types].xml", "_rels/.rels", "word/document.xml")
SLIDE_PARTS = ("[Content_Types].xml", "_rels/.rels", "ppt/presentation.xml")
OFFICE_DOCUMENT = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
SLIDE_LAYOUT = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/slideLayout"
WORD_MAIN = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"


def verdicts(files: DataFrame, check: str, issues: DataFrame, first: int = 5) -> DataFrame:
    """A row per file: not ok if ``issues`` (path, issue) names it; the first issues in order as details."""
    sample = F.slice(F.array_sort(F.collect_set("issue")), 1, first)
    found = issues.groupBy("path").agg(F.array_join(sample, "; ").alias("details"))
    return files.select("path").join(found, "path", "left").select(
        "path", F.lit(check).alias("check"), F.col("details").isNull().alias("ok"), F.coalesce("details", F.lit("")).alias("details")
    )


def zip_issues(report: DataFrame) -> DataFrame:
    return report.where("not ok").select("path", F.explode("issues").alias("issue"))


def required_issues(files: DataFrame, names: DataFrame, rels: DataFrame | None = None, required: tuple = WORD_PARTS) -> DataFrame:
    """Required parts without a member; for Word also a package relationship to the main part."""
    wanted = files.select("path", F.explode(F.array(*[F.lit(r) for r in required])).alias("name"))
    missing = wanted.join(names.select("path", "name"), ["path", "name"], "left_anti").select("path", F.concat(F.lit("missing: "), "name").alias("issue"))
    if rels is None:
        return missing
    main = rels.where((F.col("source") == "_rels/.rels") & (F.col("type_full") == OFFICE_DOCUMENT) & (F.regexp_replace("target", "^/+", "") == "word/document.xml"))
    complete = files.select("path").join(missing.select("path"), "path", "left_anti")
    return missing.unionByName(complete.join(main.select("path"), "path", "left_anti").select("path", F.lit("no package relationship to word/document.xml").alias("issue")))


def type_issues(names: DataFrame, types: DataFrame, main: tuple[str, str] | None = ("word/document.xml", WORD_MAIN)) -> DataFrame:
    """Parts that neither an override nor a default covers: two equality joins and a test for both missing."""
    ext = F.lower(F.regexp_extract("name", r"[^/]\.([^./]+)$", 1))
    own = names.where(~F.col("name").endswith("/") & (F.col("name") != "[Content_Types].xml") & ~F.col("name").endswith(".rels")).select("path", "name", ext.alias("ext")).where("ext <> ''")
    by_name = types.where("kind = 'override'").select("path", F.col("key").alias("name"), F.lit(True).alias("named")).distinct()
    by_ext = types.where("kind = 'default'").select("path", F.col("key").alias("ext"), F.lit(True).alias("typed")).distinct()
    found = own.join(by_name, ["path", "name"], "left").join(by_ext, ["path", "ext"], "left").where("named is null and typed is null")
    issues = found.select("path", F.concat(F.lit("uncovered part: "), "name").alias("issue"))
    if main is None:
        return issues
    right = types.where((F.col("kind") == "override") & (F.col("key") == main[0]) & (F.col("content_type") == main[1])).select("path")
    return issues.unionByName(names.select("path").distinct().join(right, "path", "left_anti").select("path", F.lit(f"{main[0]} does not have its content type").alias("issue")))


def relationship_issues(names: DataFrame, rels: DataFrame) -> DataFrame:
    """Internal targets that leave the package or have no part."""
    own = rels.where((F.coalesce("targetMode", F.lit("Internal")) != "External") & (F.col("target") != "")).withColumn("name", resolve(F.col("source"), F.col("target")))
    out = own.where("name is null").select("path", F.concat("source", F.lit(": target leaves the package: "), "target").alias("issue"))
    lost = own.where("name is not null").join(names.select("path", "name"), ["path", "name"], "left_anti")
    return out.unionByName(lost.select("path", F.concat("source", F.lit(": no part for "), "target").alias("issue")))


def xml_issues(nodes: DataFrame) -> DataFrame:
    return nodes.where("error is not null").select("path", F.concat("part", F.lit(": "), "error").alias("issue"))


def _inside(tag: str) -> Column:
    return F.array_contains("tags", W + tag)


def revision_issues(nodes: DataFrame) -> DataFrame:
    """Tracked changes of the main part: text kinds, nesting (a deletion inside an insertion is right), attributes, ids."""
    own = nodes.where((F.col("part") == "word/document.xml") & F.col("error").isNull())
    tag = F.regexp_replace("tag", r"^\{.*\}", "")
    changes = F.filter("tags", lambda t: t.isin(W + "ins", W + "del"))
    outer = F.regexp_replace(F.element_at(F.when(F.size(changes) > 0, changes), -1), r"^\{.*\}", "")
    change = F.col("tag").isin(W + "ins", W + "del")
    each = own.select("path", F.explode(F.array_compact(F.array(
        F.when((F.col("tag") == W + "delText") & ~_inside("del"), F.lit("w:delText outside w:del")),
        F.when((F.col("tag") == W + "delText") & _inside("ins") & ~_inside("del"), F.lit("w:delText inside w:ins without w:del")),
        F.when((F.col("tag") == W + "t") & _inside("del"), F.lit("w:t inside w:del")),
        F.when(change & outer.isNotNull() & ~((tag == "del") & (outer == "ins")), F.concat(F.lit("nested change w:"), tag, F.lit(" inside w:"), outer)),
        *[F.when(change & (F.coalesce(attr(W + a), F.lit("")) == ""), F.concat(F.lit("w:"), tag, F.lit(f" without w:{a}"))) for a in ("id", "author", "date")],
    ))).alias("issue"))
    twice = own.where(change).groupBy("path", attr(W + "id").alias("id")).count().where("id <> '' and count > 1")
    return each.unionByName(twice.select("path", F.concat(F.lit("repeated change id: "), "id").alias("issue")))


def comment_issues(nodes: DataFrame) -> DataFrame:
    """Comment references without a definition, a range start or a range end: three anti-joins. Packages without comments pass."""
    ids = lambda part, tag: nodes.where((F.col("part") == part) & (F.col("tag") == W + tag)).select("path", attr(W + "id").alias("id")).distinct()
    has = nodes.where(F.col("part") == "word/comments.xml").select("path").distinct()
    refs = ids("word/document.xml", "commentReference").join(has, "path", "left_semi")
    out = None
    for part, tag, what in (("word/comments.xml", "comment", "a definition"), ("word/document.xml", "commentRangeStart", "a range start"), ("word/document.xml", "commentRangeEnd", "a range end")):
        lost = refs.join(ids(part, tag), ["path", "id"], "left_anti").select("path", F.concat(F.lit("comment "), "id", F.lit(f" has not {what}")).alias("issue"))
        out = lost if out is None else out.unionByName(lost)
    return out


def slide_issues(names: DataFrame, nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """Slide ids whose relationship or part is missing."""
    ids = nodes.where((F.col("part") == "ppt/presentation.xml") & (F.col("tag") == P + "sldId")).select("path", F.coalesce(attr(R + "id"), F.lit("")).alias("id"))
    own = rels.where(F.col("source") == "ppt/_rels/presentation.xml.rels").select("path", "id", resolve(F.col("source"), F.col("target")).alias("name"), F.lit(True).alias("known")).dropDuplicates(["path", "id"])
    rows = ids.join(own, ["path", "id"], "left").join(names.select("path", "name", F.lit(True).alias("there")).distinct(), ["path", "name"], "left")
    issue = F.when(F.col("id") == "", F.lit("a slide id without a relationship id")).when(F.col("known").isNull(), F.concat(F.lit("slide relationship not found: "), "id")).when(F.col("there").isNull(), F.concat(F.lit("slide part not found: "), F.coalesce("name", F.lit("?"))))
    return rows.select("path", issue.alias("issue")).where("issue is not null")


def layout_issues(names: DataFrame, rels: DataFrame) -> DataFrame:
    """Slides without a layout relationship, or with one whose part is missing."""
    slides = names.where(F.col("name").rlike(r"^ppt/slides/slide[^/]*\.xml$")).select("path", F.col("name").alias("slide")).withColumn("source", F.concat(F.regexp_replace("slide", "^ppt/slides/", "ppt/slides/_rels/"), F.lit(".rels")))
    layouts = rels.where(F.col("type_full") == SLIDE_LAYOUT).groupBy("path", "source").agg(F.min_by("target", "ord").alias("target"))
    none = slides.join(layouts, ["path", "source"], "left_anti").select("path", F.concat("slide", F.lit(": no layout relationship")).alias("issue"))
    lost = slides.join(layouts, ["path", "source"]).withColumn("name", resolve(F.col("source"), F.col("target"))).join(names.select("path", "name"), ["path", "name"], "left_anti")
    return none.unionByName(lost.select("path", F.concat("slide", F.lit(": layout part not found: "), "target").alias("issue")))


def validate(files: DataFrame, listing: DataFrame, report: DataFrame, contents: DataFrame, nodes: DataFrame, slides: bool = False) -> DataFrame:
    """All checks of all files. A file that fails the archive check has that row alone.

    Every check reads the tables anew: pass them cut, or they are parsed once per check.
    Of ``contents`` only the rows with an error are used.
    """
    sound = report.where("ok").select("path")
    ok = files.select("path").join(sound, "path", "left_semi")
    names = listing.join(sound, "path", "left_semi")
    rels, types = relationships(nodes), content_types(nodes)
    damaged = contents.where("error is not null").select("path", F.concat(F.lit("corrupt entry: "), F.coalesce("name", "error")).alias("issue"))
    out = verdicts(files, "zip_integrity", zip_issues(report).unionByName(damaged))
    checks = [
        ("required_parts", required_issues(ok, names, None if slides else rels, SLIDE_PARTS if slides else WORD_PARTS)),
        ("content_types", type_issues(names, types, None if slides else ("word/document.xml", WORD_MAIN))),
        ("relationships", relationship_issues(names, rels)),
        ("wellformed_xml", xml_issues(nodes)),
    ]
    checks += [("slide_consistency", slide_issues(names, nodes, rels)), ("layout_master_chain", layout_issues(names, rels))] if slides else [("tracked_changes", revision_issues(nodes)), ("comments", comment_issues(nodes))]
    for name, issues in checks:
        out = out.unionByName(verdicts(ok, name, issues))
    return out


def overall(checks: DataFrame) -> DataFrame:
    return checks.groupBy("path").agg(F.bool_and("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed_checks"))


def totals(checks: DataFrame) -> DataFrame:
    """How many files were validated and how many failed."""
    return overall(checks).agg(F.count(F.lit(1)).alias("validated"), F.count_if(~F.col("ok")).alias("failed"))
