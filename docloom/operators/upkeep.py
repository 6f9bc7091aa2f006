"""What documents need when code changes: plans from a diff, grounding of sections in files, names that are gone.

A diff is given as changes (path, status), with status A, M, D or R, and lines (path, sign, line, text): sign + or -, line
the number in the new file. Names and paths are matched as whole tokens by equi joins, never text against text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import all_of

#: Kinds of files, shapes of names.
DOCUMENT = r"\.(md|mdx|rst|adoc|txt)$"
CODE = r"\.(py|ts|tsx|js|jsx|mjs|cjs|go|rs|rb|java|kt|swift|php|cs|c|cc|cpp|h|tf|sql)$"
CONFIG = (
    r"(^|/)(Dockerfile[^/]*|docker-compose[^/]*\.ya?ml|compose[^/]*\.ya?ml|[^/]*crontab|Makefile|"
    r"\.github/workflows/[^/]+\.ya?ml|[^/]+\.sh|[^/]+\.toml|deploy/[^/]+\.ya?ml|config/[^/]+\.ya?ml)$"
)
SKIPPED = r"(^|/)(tests?|__tests__|spec|fixtures|migrations|vendor|dist|build|node_modules)/|\.(test|spec)\.\w+$|(^|/)(package-lock\.json|uv\.lock|poetry\.lock|yarn\.lock|pnpm-lock\.yaml)$"
OPERATOR_NAME = r"(?<![\w-])(--[a-z][a-z0-9-]{2,}|[A-Z][A-Z0-9]*_[A-Z0-9_]{2,}|[a-z][\w-]*:[a-z][\w:-]+)(?![\w-])"
NAMED_IN_TEXT = r"--[a-z][a-z0-9-]{2,}|[A-Z][A-Z0-9]*_[A-Z0-9_]{2,}|[a-z][\w-]*:[a-z][\w:-]+"
IMPORT = r"^\s*(import\b|from\s+\S+\s+import\b|.*\brequire\()"
SETTING = r"(?:process\.env\.|import\.meta\.env\.|os\.environ(?:\.get)?\(?\[?[\"']|getenv\([\"']|ENV\[[\"']|\$\{?|^\s*(?:export\s+)?|^\s*-?\s*)([A-Z][A-Z0-9]*_[A-Z0-9_]{2,})(?![\w-])"
IDENTIFIER = r"[a-z][A-Z]|_|[./]|\d|^[A-Z][A-Z0-9_]{3,}$"
PATH_OR_CALL = r"^(?:(?:[\w.-]+/)*[\w.-]+\.(?:py|ts|tsx|js|jsx|mjs|go|rs|rb|java|kt|swift|sh|ya?ml|toml|sql|tf)|[A-Za-z_][\w.]*\(\))$"


def is_document(path: Column) -> Column:
    return F.lower(path).rlike(DOCUMENT)


def is_code(path: Column) -> Column:
    return ~path.rlike(SKIPPED) & (F.lower(path).rlike(CODE) | path.rlike(CONFIG))


def spans_of(text: Column, run: str, cut: str, glue: str, most: int) -> Column:
    """All spans of up to `most` parts of the runs in a text, the parts cut and glued again: what a name that is some parts
    of a longer one is found by."""
    runs = F.array_distinct(all_of(text, run))

    def spans(r: Column) -> Column:
        parts = F.split(r, cut)
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - i + 1, F.lit(most))), lambda n: F.array_join(F.slice(parts, i, n), glue))))

    return F.array_distinct(F.flatten(F.transform(runs, spans)))


def changed_terms(lines: DataFrame) -> DataFrame:
    """(path, term): the distinctive identifiers on added and removed lines."""
    words = F.transform(all_of(F.col("text"), r"[A-Za-z_][\w:.-]{3,}"), lambda w: F.regexp_replace(w, "^[.:-]+|[.:-]+$", ""))
    terms = lines.select("path", F.explode(words).alias("term"))
    upper = (F.col("term") == F.upper("term")) & F.col("term").rlike("[A-Z]")
    return terms.filter((F.length("term") >= 5) & (F.col("term").rlike("[_:-]|[a-z][A-Z]") | upper)).distinct()


def added_names(lines: DataFrame) -> DataFrame:
    """(path, name): names for operators (flags, settings, tasks) on added lines and on no removed one. Import lines and
    URLs don't count; a name in capitals only where it is read or set as a setting."""
    rows = lines.filter(~F.coalesce(F.col("text").rlike(IMPORT), F.lit(False))).select("path", "sign", F.regexp_replace("text", r"https?://\S+", " ").alias("text"))
    names = rows.select("path", "sign", F.explode(all_of(F.col("text"), OPERATOR_NAME, 1)).alias("name")).distinct()
    settings = rows.select("path", "sign", F.explode(all_of(F.col("text"), SETTING, 1)).alias("name")).distinct()
    plain = names.filter(~F.col("name").rlike("^[A-Z]") & ~F.col("name").startswith("node:"))
    kept = plain.union(names.filter(F.col("name").rlike("^[A-Z]")).join(settings, ["path", "sign", "name"], "left_semi"))
    return kept.filter("sign = '+'").select("path", "name").join(kept.filter("sign = '-'").select("path", "name"), ["path", "name"], "left_anti")


def new_names(changes: DataFrame, lines: DataFrame, sections: DataFrame) -> DataFrame:
    """(path, name) of the added names of code files that no section has as a name."""
    code = changes.filter(is_code(F.col("path")) & (F.col("status") != "D")).select("path").distinct()
    known = sections.select(F.explode(all_of(F.col("text"), NAMED_IN_TEXT)).alias("name")).distinct()
    return added_names(lines).join(code, "path", "left_semi").join(known, "name", "left_anti").select("path", "name")


def symbol_spans(nodes: DataFrame) -> DataFrame:
    """nodes (node_id, label, path, line) with `last`: the line before the next one at which a symbol of the file begins."""
    starts = nodes.select("path", "line").distinct()
    last = F.coalesce(F.lead("line").over(Window.partitionBy("path").orderBy("line")) - 1, F.lit(1_000_000_000))
    return nodes.join(starts.withColumn("last", last), ["path", "line"])


def documentation_plan(changes: DataFrame, lines: DataFrame, nodes: DataFrame, links: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sections to look at, (section_id, path, priority, reasons, files), and the changed files that no section is
    about, (path, status, symbols).

    nodes: (node_id, label, path, line), links: (section_id, node_id, mention), sections: (id, path, text). Priority 0: a
    linked symbol changed, a file is deleted, or the text has a term of the changed lines; 1: only the file changed. A
    link counts for a file if its mention names it: one like a path must be the path's end, a plain word in lower case
    without call brackets never counts. Sections that have the path, or its last two parts in backticks, belong to the
    file too. Sections of documents that the same diff edits are left out."""
    code = changes.filter(is_code(F.col("path"))).select("path", "status").distinct()
    edited = changes.filter(is_document(F.col("path"))).select("path").distinct()
    hunks = lines.filter("line is not null").groupBy("path", "line").agg(F.lit(1).alias("x")).select("path", F.col("line").alias("at"))
    name = F.regexp_extract("path", "[^/]*$", 0)
    inside = symbol_spans(nodes).join(code.filter("status <> 'D'"), "path").filter(F.col("label") != name)
    changed = inside.join(hunks, "path").filter("at between line and last").select("path", "node_id", "label").distinct()
    m = F.regexp_replace(F.regexp_replace("mention", "^`+|`+$", ""), r"^\./", "")
    like_path = m.contains("/") | m.rlike(r"\.\w{1,5}$")
    ends = (F.col("path") == m) | F.col("path").endswith(F.concat(F.lit("/"), m))
    plain = F.regexp_replace(m, r"[()]+$", "").rlike("^[a-z]+$") & ~m.endswith("()")
    about = links.join(nodes.select("node_id", "path", "label").join(code.select("path"), "path", "left_semi"), "node_id")
    about = about.filter(F.when(like_path, ends).otherwise(~plain)).select("section_id", "node_id", "path").distinct()
    by_symbol = about.join(changed, ["node_id", "path"]).groupBy("section_id", "path").agg(F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("labels"))
    reasons = by_symbol.select("section_id", "path", F.concat(F.lit("symbol changed: "), "labels").alias("reason"))
    # Paths in the texts: as whole parts of a longer one, or two parts in backticks.
    said = sections.select(F.col("id").alias("section_id"), F.explode(spans_of(F.col("text"), r"[\w./-]+", "/", "/", 12)).alias("path"))
    tails = code.select("path", F.array_join(F.slice(F.split("path", "/"), F.greatest(-F.size(F.split("path", "/")), F.lit(-2)), 2), "/").alias("tail"))
    ticked = sections.select(F.col("id").alias("section_id"), F.explode(F.array_distinct(all_of(F.col("text"), r"`([^`\n]+)`", 1))).alias("tail"))
    named = said.join(code.select("path"), "path").select("section_id", "path").union(ticked.join(tails, "tail").select("section_id", "path"))
    by_file = about.select("section_id", "path").union(named).distinct()
    others = by_file.join(by_symbol, ["section_id", "path"], "left_anti").join(code, "path")
    hit = others.join(changed_terms(lines), "path").join(sections.select(F.col("id").alias("section_id"), "text"), "section_id").filter(F.contains("text", "term"))
    hit = hit.groupBy("section_id", "path").agg(F.array_join(F.slice(F.array_sort(F.collect_set("term")), 1, 4), ", ").alias("terms"))
    why = F.when(F.col("status") == "D", "deleted file").when(F.col("terms").isNotNull(), F.concat(F.lit("names changed text: "), "terms")).otherwise("file changed")
    reasons = reasons.union(others.join(hit, ["section_id", "path"], "left").select("section_id", "path", why.alias("reason")))
    first = F.min(F.when(F.col("reason") == "file changed", 1).otherwise(0))
    wanted = reasons.groupBy("section_id").agg(first.alias("priority"), F.array_sort(F.collect_set("reason")).alias("reasons"), F.array_sort(F.collect_set("path")).alias("files"))
    update = wanted.join(sections.select(F.col("id").alias("section_id"), "path"), "section_id").join(edited, "path", "left_anti").select("section_id", "path", "priority", "reasons", "files")
    bare = code.filter("status <> 'D'").join(by_file.select("path"), "path", "left_anti")
    held = inside.groupBy("path").agg(F.slice(F.array_sort(F.collect_set("label")), 1, 8).alias("symbols"))
    return update, bare.join(held, "path", "left").select("path", "status", F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"))


def plan_text(update: DataFrame) -> DataFrame:
    """(section_id, line, key) of a plan's sections: a line to show, and what is the same for the same request again."""
    line = F.concat(F.lit("- "), "path", F.lit(" ("), F.array_join("reasons", "; "), F.lit(")"))
    return update.select("section_id", line.alias("line"), F.sha1(F.concat_ws("|", "section_id", F.array_join("reasons", ";"), F.array_join("files", ";"))).alias("key"))


def section_names(sections: DataFrame, links: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(section_id, name): the identifiers that a section uses, from its mentions and what stands in backticks, whole and by
    their last part. Plain words don't count, as they occur in almost any change."""
    ticked = sections.select(F.col("id").alias("section_id"), F.explode(all_of(F.col("text"), r"`([^`\n]{2,80})`", 1)).alias("raw"))
    raw = ticked.union(links.select("section_id", "mention")).union(unresolved.select("section_id", "mention")).filter("raw is not null").distinct()
    part = F.explode(F.split(F.regexp_replace(F.trim("raw"), "^`+|`+$", ""), r"\s+"))
    part = raw.select("section_id", part.alias("p")).select("section_id", F.regexp_replace(F.regexp_replace("p", r"^[()\[\]{},;:'\"]+|[()\[\]{},;:'\"]+$", ""), r"^\.+", "").alias("p"))
    names = part.select("section_id", F.explode(F.array("p", F.regexp_extract("p", "[^.]*$", 0), F.regexp_extract("p", "[^/]*$", 0))).alias("name")).distinct()
    return names.filter((F.length("name") >= 4) & F.col("name").rlike(r"^[\w.$/-]+$") & F.col("name").rlike(IDENTIFIER))


def grounding(sections: DataFrame, docs: DataFrame, links: DataFrame, nodes: DataFrame, unresolved: DataFrame, file_times: DataFrame, changed: DataFrame, most: int = 3) -> DataFrame:
    """(section_id, place, file, stale_names): up to `most` files to check a section against, core and config first, then
    in the order of its links; a section that links to none takes those of its page. stale_names: up to four names of the
    section that stand as a whole in lines of the file changed after the document's last commit; empty if it isn't stale.

    sections: (id, path, ordinal, text), docs: (path, time), links: (section_id, node_id, mention, place), nodes:
    (node_id, file, first) with first = 0 for core and config, file_times: (file, time), changed: (file, time, text)."""
    linked = links.join(nodes.filter("file is not null and file <> ''"), "node_id")
    own = linked.groupBy("section_id", "file").agg(F.min(F.struct("first", F.col("place").cast("bigint"))).alias("o"))
    pages = sections.select(F.col("id").alias("section_id"), "path", "ordinal")
    paged = linked.join(pages, "section_id").groupBy("path", "file").agg(F.min(F.struct("first", "ordinal", F.col("place").cast("bigint"))).alias("o"))
    numbered = lambda df, by: df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("o", "file"))).filter(F.col("place") <= most)
    bare = pages.join(own, "section_id", "left_anti")
    verify = numbered(own, "section_id").select("section_id", "place", "file").union(bare.join(numbered(paged, "path"), "path").select("section_id", "place", "file"))
    timed = verify.join(pages, "section_id").join(docs.groupBy("path").agg(F.max("time").alias("doc_time")), "path", "left").join(file_times.groupBy("file").agg(F.max("time").alias("file_time")), "file", "left")
    newer = timed.filter("file_time > doc_time").select("section_id", "file", "doc_time")
    tokens = changed.select("file", "time", F.explode(spans_of(F.col("text"), r"[\w.$/-]+", r"(?<=[.$/])|(?=[.$/])", "", 12)).alias("name"))
    latest = tokens.groupBy("file", "name").agg(F.max("time").alias("time"))
    hit = newer.join(section_names(sections, links, unresolved), "section_id").join(latest, ["file", "name"]).filter("time > doc_time")
    hit = hit.groupBy("section_id", "file").agg(F.slice(F.array_sort(F.collect_set("name")), 1, 4).alias("stale_names"))
    return verify.join(hit, ["section_id", "file"], "left").select("section_id", "place", "file", F.coalesce("stale_names", F.array().cast("array<string>")).alias("stale_names"))


def missing_names(unresolved: DataFrame, sections: DataFrame, docs: DataFrame, files: DataFrame, words: DataFrame, most: int = 5) -> DataFrame:
    """(section_id, place, name): up to `most` names of a section, in order, that should be in the code and aren't: a call whose
    last part no file that isn't a document has as a word; a path whose folder exists, at the root or beside the document,
    and which itself doesn't; a bare file name only if no tracked file has that name and no source file has the word.

    unresolved: (section_id, mention), sections: (id, path), docs: (path, folder), files: (path) of all tracked files,
    words: (word, source): the words of files that are no documents, source true for programs."""
    m = F.regexp_replace(F.trim("mention"), "^`+|`+$", "")
    rows = unresolved.select("section_id", m.alias("name")).filter(F.col("name").rlike(PATH_OR_CALL) & ~F.col("name").startswith("http") & ~F.col("name").startswith("/")).distinct()
    calls = rows.filter(F.col("name").endswith("()")).withColumn("word", F.regexp_extract("name", r"([^.]*)\(\)$", 1))
    calls = calls.join(words.select("word").distinct(), "word", "left_anti").select("section_id", "name")
    paths = rows.filter(~F.col("name").endswith("()"))
    beside = paths.join(sections.select(F.col("id").alias("section_id"), "path").distinct(), "section_id").join(docs.select("path", "folder").distinct(), "path").select("section_id", "name", "folder")
    tried = paths.select("section_id", "name", F.lit("").alias("folder")).union(beside).distinct()
    at = F.when(F.col("folder") == "", F.col("name")).otherwise(F.concat_ws("/", "folder", "name"))
    tried = tried.select("section_id", "name", at.alias("at"), F.regexp_replace(at, "/?[^/]*$", "").alias("parent"))
    parts = F.split("path", "/")
    folders = files.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("parent")).distinct()
    gone = tried.join(folders, "parent", "left_semi").join(files.select(F.col("path").alias("at")).distinct(), "at", "left_anti").select("section_id", "name").distinct()
    bare = gone.filter(~F.contains("name", F.lit("/"))).join(files.select(F.regexp_extract("path", "[^/]*$", 0).alias("name")).distinct(), "name", "left_anti")
    bare = bare.join(words.filter("source").select(F.col("word").alias("name")).distinct(), "name", "left_anti").select("section_id", "name")
    out = calls.union(gone.filter(F.contains("name", F.lit("/")))).union(bare)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("section_id").orderBy("name"))).filter(F.col("place") <= most).select("section_id", "place", "name")
