"""Names in documents and the symbols they stand for.

A name is looked up once for each component that mentions it, not for each section; only whether a plain word may link
is decided by the section's own text. All look-ups are equi joins on names, and paths match by the tails they end in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import BARE_WORD, CODE_SHAPED, TICKED, all_of, bare_mention, mentions, specificity

#: Paths of tests and examples, and names of folders.
TEST_PATH = r"(^|/)(tests?|__tests__|spec|specs|e2e|fixtures?|testing)(/|$)|[._-](test|spec)\.[a-z]+$|(^|/)(test_[^/]+|conftest\.py)$"
EXAMPLE_PATH = r"(^|/)(examples?|samples?)(/|$)"
NO_CORE = "test tests __tests__ spec e2e fixtures examples example docs doc scripts tools benchmarks migrations stories storybook".split()
CORE_STRONG = "backend server api services service worker workers jobs pipeline db database core internal cmd scraper".split()
CORE_WEAK = "src lib pkg".split()


def _none() -> Column:
    return F.array().cast("array<string>")


def section_mentions(sections: DataFrame) -> DataFrame:
    """(section_id, component, mention, ticked, name) of the distinct names in each section (id, component, text); ticked:
    it stands in backticks; name: without what stands around it."""
    rows = sections.select(F.col("id").alias("section_id"), "component", "text").distinct()
    each = rows.select("section_id", "component", F.array_distinct(all_of(F.col("text"), TICKED, 1)).alias("ticks"), F.explode(mentions(F.col("text"))).alias("mention"))
    return each.select("section_id", "component", "mention", F.array_contains("ticks", F.col("mention")).alias("ticked"), bare_mention(F.col("mention")).alias("name"))


def _folders(path: Column) -> Column:
    """The folders a path lies in, from the first two parts on (a component and a folder of it)."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(_none())


def core_folders(nodes: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """(folder) of the project's core, component first. explicit: (component, path) named by the project; if any are, they
    are the core. Otherwise the highest folders with the name of a server side that hold code, or if there are none, of a
    library; never below tests, examples, documents, scripts or tools. No row: there is no core, and everything counts."""
    if explicit is not None and not explicit.isEmpty():
        return explicit.select(F.concat_ws("/", "component", F.regexp_replace("path", "^/+|/+$", "")).alias("folder")).distinct()
    held = nodes.filter((F.col("source_file") != "") & ~F.col("source_file").rlike(TEST_PATH)).select(F.explode(_folders(F.col("source_file"))).alias("folder")).distinct()
    parts = F.split("folder", "/")
    name = F.element_at(parts, -1)
    inner = F.slice(parts, 2, F.size(parts))
    fit = held.filter(~F.exists(inner, lambda x: x.isin(NO_CORE) | x.startswith(".")))
    fit = fit.withColumn("weak", F.when(name.isin(CORE_STRONG), 0).when(name.isin(CORE_WEAK), 1)).filter("weak is not null")
    best = fit.agg(F.min("weak").alias("best"))  # one row
    fit = fit.join(F.broadcast(best), F.col("weak") == F.col("best")).select("folder")
    # The highest ones: those none of whose own folders is one of them.
    below = fit.select("folder", F.explode(_folders(F.concat("folder", F.lit("/x")))).alias("above")).filter("above <> folder")
    return fit.join(below.join(fit.select(F.col("folder").alias("above")), "above").select("folder"), "folder", "left_anti")


def with_core(rows: DataFrame, path: str, core: DataFrame | None) -> DataFrame:
    """rows with `core`: whether the path lies in a folder of the core; true everywhere if there is no core."""
    if core is None or core.isEmpty():
        return rows.withColumn("core", F.lit(True))
    inside = rows.select(path).distinct().select(path, F.explode(_folders(F.col(path))).alias("folder")).join(core, "folder").select(path).distinct().withColumn("core", F.lit(True))
    return rows.join(inside, path, "left").withColumn("core", F.coalesce("core", F.lit(False)))


def symbol_facts(nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(node_id, component, label, file, role, class, test) of nodes (id, label, source_file, component, and kind and
    file_type if there). role: file (the label is the file's name), method or top (by an edge method or contains into
    it), else nested; without edges everything but files is top. class: the label of what a method belongs to. Nodes
    without a label, with one of over 80 characters, and rationales are left out."""
    label = F.trim("label")
    rows = nodes.filter((label != "") & (F.length(label) <= 80))
    for c in ("kind", "file_type"):
        rows = rows.filter(F.coalesce(F.col(c), F.lit("")) != "rationale") if c in nodes.columns else rows
    file = F.coalesce("source_file", F.lit(""))
    rows = rows.select(F.col("id").alias("node_id"), "component", label.alias("label"), file.alias("file")).distinct()
    if edges is None:
        rows = rows.withColumns({"relation": F.lit("contains"), "class": F.lit("")})
    else:
        owners = nodes.select(F.col("id").alias("source"), F.col("label").alias("class")).distinct()
        into = edges.filter(F.col("relation").isin("contains", "method")).join(owners, "source", "left")
        into = into.groupBy(F.col("target").alias("node_id")).agg(F.max(F.struct("relation", F.coalesce("class", F.lit("")).alias("class"))).alias("e"))
        rows = rows.join(into, "node_id", "left").select("*", "e.relation", F.coalesce("e.class", F.lit("")).alias("class")).drop("e")
    is_file = (F.col("file") != "") & (F.col("label") == F.regexp_extract("file", "[^/]*$", 0))
    role = F.when(is_file, "file").when(F.col("relation") == "method", "method").when(F.col("relation") == "contains", "top").otherwise("nested")
    test = F.col("file").rlike(TEST_PATH) | F.col("file").rlike(EXAMPLE_PATH)
    return rows.withColumns({"role": role, "test": test, "class": F.when(F.col("relation") == "method", F.col("class")).otherwise("")}).drop("relation")


def name_index(facts: DataFrame, longest_tail: int = 4) -> DataFrame:
    """(name, how, *facts): the names that nodes answer to. A file by the last one to four parts of its path below the
    component; a symbol by its label without call brackets, a method by class and label and, as how = method, by its
    label alone. Symbols of tests and examples, nested ones, those without a file and names under three characters are
    left out."""
    parts = F.split("file", "/")
    inner = F.slice(parts, 2, F.size(parts))
    tails = F.when(F.size(inner) > 0, F.transform(F.sequence(F.lit(1), F.least(F.size(inner), F.lit(longest_tail))), lambda k: F.array_join(F.slice(inner, -k, k), "/"))).otherwise(_none())
    files = facts.filter("role = 'file'").select(F.explode(tails).alias("name"), F.lit("exact").alias("how"), "*")
    key = F.regexp_replace(F.regexp_replace("label", r"\(\)$", ""), r"^\.+", "")
    symbols = facts.filter("role in ('method', 'top') and file <> '' and not test").withColumn("key", key).filter("length(key) >= 3")
    owned = (F.col("role") == "method") & (F.col("class") != "")
    exact = symbols.select(F.when(owned, F.concat_ws(".", "class", "key")).otherwise(F.col("key")).alias("name"), F.lit("exact").alias("how"), *facts.columns)
    methods = symbols.filter(owned).select(F.col("key").alias("name"), F.lit("method").alias("how"), *facts.columns)
    return files.union(exact).union(methods)


def candidates(asked: DataFrame, index: DataFrame, core: DataFrame | None = None, most: int = 3) -> DataFrame:
    """(component, mention, name, node_id, n, role, test, file, core): what each of asked (component, mention, name) may
    stand for, if at most `most` nodes.

    A name is looked up as it is, then (code-shaped and no plain word) as a method, then, if it is dotted, by its last
    part, where an earlier part must name the class, or a part of the file's path, of three characters or more. Nodes of the
    own component go before others; of several, a single one in the core is taken, except for paths. n is the number
    that is left."""
    name = F.col("name")
    dotted = F.contains(name, F.lit(".")) & ~F.contains(name, F.lit("/")) & ~name.rlike(r"^(var\.|module\.|aws_)")
    ways = F.array(
        F.struct(F.lit(0).alias("way"), name.alias("key")),
        F.when(name.rlike(CODE_SHAPED) & ~name.rlike(BARE_WORD) & ~F.contains(name, F.lit(".")), F.struct(F.lit(1).alias("way"), name.alias("key"))),
        F.when(dotted, F.struct(F.lit(2).alias("way"), F.regexp_extract("name", r"[^.]*$", 0).alias("key"))),
    )
    looked = asked.select("component", "mention", "name", F.explode(F.array_compact(ways)).alias("w")).select("*", "w.way", "w.key").drop("w")
    index = with_core(index, "file", core).withColumnRenamed("name", "key").withColumnRenamed("component", "of")
    met = looked.join(index, "key").filter((F.col("way") == 2) | (F.col("how") == F.when(F.col("way") == 0, "exact").otherwise("method")))
    tokens = F.filter(F.split(F.lower("file"), "[/._-]"), lambda t: F.length(t) >= 3)
    owner = F.lower("class")
    before = F.transform(F.filter(F.slice(F.split("name", r"\."), 1, F.size(F.split("name", r"\.")) - 1), lambda p: F.lit(True)), lambda p: F.regexp_replace(F.lower(p), "^~+", ""))
    names_it = F.exists(before, lambda p: (F.length(p) >= 3) & (F.array_contains(tokens, p) | ((owner != "") & F.contains(owner, p))))
    met = met.filter((F.col("way") < 2) | names_it).withColumn("own", F.col("component").eqNullSafe(F.col("of")))
    met = met.select("component", "mention", "name", "way", "own", "node_id", "role", "test", "file", "core").distinct()
    w = Window.partitionBy("component", "mention", "name")
    met = met.withColumn("first", F.min("way").over(w)).filter("way = first")
    met = met.withColumn("any_own", F.max("own").over(w)).filter("own or not any_own")
    met = met.dropDuplicates(["component", "mention", "name", "node_id"])
    has_core = F.lit(core is not None and not core.isEmpty())
    met = met.withColumns({"n": F.count("*").over(w), "in_core": F.sum(F.col("core").cast("int")).over(w)})
    single = has_core & (F.col("n") > 1) & (F.col("in_core") == 1) & (specificity(name) > 0)
    met = met.filter(~single | F.col("core")).withColumn("n", F.when(single, 1).otherwise(F.col("n")))
    return met.filter(F.col("n") <= most).select("component", "mention", "name", "node_id", "n", "role", "test", "file", "core")


def link_sections(sections: DataFrame, nodes: DataFrame, edges: DataFrame | None = None, core: DataFrame | None = None, said: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The links (section_id, node_id, mention, confidence, score, core, specificity, position) and the unresolved
    mentions (section_id, mention) of sections (id, component, text).

    One candidate is EXTRACTED at 1.0, two or three are AMBIGUOUS at 0.3 each, more give no link. A plain word is
    EXTRACTED only for a top-level symbol outside tests, and in lower case only if that lies in the core and the text
    has its file's name. position: EXTRACTED first, then the core, then paths, qualified names, code, words. Unresolved
    is a mention in backticks of code shape, without blanks, that has no candidate at all. said: the mentions, as
    section_mentions gives them, where they aren't to be read from the texts."""
    said = section_mentions(sections) if said is None else said
    index = name_index(symbol_facts(nodes, edges))
    asked = said.select("component", "mention", "name").distinct()
    found = candidates(asked, index, core, 1 << 62)
    texts = sections.select(F.col("id").alias("section_id"), "text").distinct()
    met = said.join(found.filter("n <= 3").withColumnRenamed("component", "_of").withColumnRenamed("mention", "_said").drop("name"), (F.col("_of").eqNullSafe(F.col("component"))) & (F.col("_said") == F.col("mention")))
    plain = F.col("name").rlike(BARE_WORD)
    here = texts.join(met.filter(plain).select("section_id").distinct(), "section_id", "left_semi").withColumnRenamed("section_id", "_at")
    met = met.join(here, (F.col("_at") == F.col("section_id")) & plain, "left")
    named = F.col("core") & F.contains("text", F.regexp_extract("file", "[^/]*$", 0))
    may = (F.col("role") == "top") & ~F.col("test") & (F.col("name").rlike("^[A-Z]") | F.coalesce(named, F.lit(False)))
    sure = (F.col("n") == 1) & (~plain | may)
    links = met.select("section_id", "node_id", F.col("name").alias("mention"), "core", specificity(F.col("name")).alias("specificity"), sure.alias("sure"), F.col("mention").alias("_as"))
    links = links.withColumns({"confidence": F.when(F.col("sure"), "EXTRACTED").otherwise("AMBIGUOUS"), "score": F.when(F.col("sure"), 1.0).otherwise(0.3)})
    order = Window.partitionBy("section_id").orderBy(~F.col("sure"), ~F.col("core"), "specificity", "_as", "node_id")
    links = links.withColumn("position", F.row_number().over(order)).drop("sure", "_as")
    open_ = said.filter(F.col("ticked") & F.col("mention").rlike(CODE_SHAPED) & ~F.contains("mention", F.lit(" ")))
    known = found.select("component", "mention").distinct().withColumnRenamed("component", "_of").withColumnRenamed("mention", "_said")
    unresolved = open_.join(known, (F.col("_of").eqNullSafe(F.col("component"))) & (F.col("_said") == F.col("mention")), "left_anti").select("section_id", "mention")
    return links, unresolved
