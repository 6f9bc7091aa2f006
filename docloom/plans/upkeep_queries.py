"""Plans from a diff, grounding and missing names, over small cases; the rows beside them are worked out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import upkeep
from docloom.plans.dialects import said
from docloom.plans.registry import query

_CHANGES = [("src/billing.py", "M"), ("deploy/start.sh", "M"), ("src/access_code.py", "A"), ("src/old.py", "D"), ("tests/test_a.py", "M"), ("docs/EDITED.md", "M"), ("src/quiet.py", "M")]
_LINES = [
    ("src/billing.py", "-", None, "    return -x"), ("src/billing.py", "+", 6, "    return 0"), ("deploy/start.sh", "-", None, "exec app --port 8080"), ("deploy/start.sh", "+", 2, 'exec app --port "$APP_PORT" --dry-run'),
    ("deploy/start.sh", "+", 3, "export MIGRATE_ON_START=1"), ("deploy/start.sh", "+", 4, "echo see https://x.example/a:b NOT_A_SETTING"), ("src/access_code.py", "+", 1, "def redeem(code):"), ("src/access_code.py", "+", 2, "import node:fs"),
    ("src/quiet.py", "+", 1, "x = 1"),
]
_NODES = [
    ("f", "billing.py", "src/billing.py", 1), ("c", "charge_invoice()", "src/billing.py", 1), ("r", "refund()", "src/billing.py", 5), ("p", "proxy()", "src/billing.py", 5), ("n", "redeem()", "src/access_code.py", 1), ("o", "old()", "src/old.py", 1),
    ("q", "quiet_step()", "src/quiet.py", 9),
]
_SECTIONS = [
    ("s1", "docs/BILLING.md", "Call `charge_invoice()` to bill."), ("s2", "docs/BILLING.md", "Use `refund()`."), ("s3", "docs/BILLING.md", "The `proxy` setting."), ("s4", "docs/DEPLOY.md", "Run `deploy/start.sh`; it listens on `APP_PORT`, with `--port`."),
    ("s5", "docs/OLD.md", "The old() step."), ("s6", "docs/EDITED.md", "Use `refund()` here too."), ("s7", "docs/PATHS.md", "See proj/src/quiet.py for more."), ("s8", "docs/PATHS.md", "The file other/billing.py is another."), ("s9", "docs/PATHS.md", None),
]
_LINKS = [("s1", "c", "charge_invoice()"), ("s2", "r", "refund()"), ("s3", "p", "proxy"), ("s5", "o", "old()"), ("s6", "r", "refund()"), ("s8", "f", "other/billing.py")]


def _diff(spark: SparkSession) -> tuple[DataFrame, ...]:
    make = spark.createDataFrame
    return (
        make(_CHANGES, "path string, status string"), make(_LINES, "path string, sign string, line int, text string"), make(_NODES, "node_id string, label string, path string, line int"),
        make(_LINKS, "section_id string, node_id string, mention string"), make(_SECTIONS, "id string, path string, text string"),
    )


_PLAN = [
    ("s2", "docs/BILLING.md", 0, "symbol changed: refund()", "src/billing.py"), ("s1", "docs/BILLING.md", 1, "file changed", "src/billing.py"), ("s4", "docs/DEPLOY.md", 0, "names changed text: APP_PORT", "deploy/start.sh"),
    ("s5", "docs/OLD.md", 0, "deleted file", "src/old.py"), ("s7", "docs/PATHS.md", 1, "file changed", "src/quiet.py"),
]


@query("docs_plan_rules", said("section_id, path, priority, reasons, files", _PLAN))
def docs_plan_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    update = upkeep.documentation_plan(*_diff(spark))[0]
    return update.select("section_id", "path", "priority", F.array_join("reasons", "; ").alias("reasons"), F.array_join("files", "; ").alias("files"))


@query("docs_plan_lines", said("section_id, line", [(s, f"- {path} ({why})") for s, path, _, why, _ in _PLAN]))
def docs_plan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.plan_text(upkeep.documentation_plan(*_diff(spark))[0]).select("section_id", "line")


@query("undocumented_rules", said("path, status, symbols", [("src/access_code.py", "A", "redeem()")]))
def undocumented_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.documentation_plan(*_diff(spark))[1].select("path", "status", F.array_join("symbols", ", ").alias("symbols"))


@query("new_names_rules", said("path, name", [("deploy/start.sh", "--dry-run"), ("deploy/start.sh", "MIGRATE_ON_START")]))
def new_names_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes, lines, _, _, sections = _diff(spark)
    return upkeep.new_names(changes, lines, sections)


@query("diff_terms", said("path, term", [("deploy/start.sh", x) for x in ("APP_PORT", "MIGRATE_ON_START", "NOT_A_SETTING", "dry-run", "https", "x.example")][:4] + [("src/access_code.py", "node:fs")]))
def diff_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.changed_terms(_diff(spark)[1])


_G_SECTIONS = [
    ("a", "c/docs/a.md", 0, "Jobs are claimed by `claim_next()` in `app/jobs.py`."), ("b", "c/docs/b.md", 0, "The `deploy` step sets the `status` to done."), ("c", "c/docs/c.md", 0, "x"), ("d", "c/docs/c.md", 1, "no links: takes the page's"), ("e", "c/docs/e.md", 0, "`claim_next` of old"),
]
_G_NODES = [("n1", "c/app/jobs.py", 0), ("n2", "c/web/a.ts", 1), ("n3", "c/web/b.ts", 1), ("n4", "c/web/c.ts", 1), ("n5", "c/deploy.yml", 0), ("n6", None, 1)]
_G_LINKS = [("a", "n1", "claim_next()", 1), ("b", "n1", "status", 2), ("c", "n2", "a", 3), ("c", "n3", "b", 4), ("c", "n1", "jobs", 5), ("c", "n4", "c", 6), ("c", "n5", "d", 7), ("c", "n6", "none", 8), ("e", "n1", "claim_next", 9)]
_G_CHANGED = [("c/app/jobs.py", 200, "def claim_next():"), ("c/app/jobs.py", 200, "# deploy status"), ("c/web/a.ts", 50, "x_name"), ("c/app/jobs.py", 90, "claim_nexts and unclaim_next")]


@query("grounding_rules", said("section_id, place, file, stale_names", [
    ("a", 1, "c/app/jobs.py", "claim_next"), ("b", 1, "c/app/jobs.py", ""), *[(s, i, f, "") for s in "cd" for i, f in ((1, "c/app/jobs.py"), (2, "c/deploy.yml"), (3, "c/web/a.ts"))], ("e", 1, "c/app/jobs.py", ""),
]))
def grounding_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = spark.createDataFrame
    docs = make([("c/docs/a.md", 100), ("c/docs/b.md", 100), ("c/docs/c.md", None), ("c/docs/e.md", 300)], "path string, time bigint")
    out = upkeep.grounding(
        make(_G_SECTIONS, "id string, path string, ordinal int, text string"), docs, make(_G_LINKS, "section_id string, node_id string, mention string, place int"), make(_G_NODES, "node_id string, file string, first int"),
        make([], "section_id string, mention string"), make([("c/app/jobs.py", 200), ("c/web/a.ts", 50)], "file string, time bigint"), make(_G_CHANGED, "file string, time bigint, text string"),
    )
    return out.select("section_id", "place", "file", F.array_join("stale_names", ", ").alias("stale_names"))


@query("missing_names_rules", said("section_id, place, name", [("s1", 1, "gone_call()"), ("s1", 2, "rpa.js"), ("s1", 3, "src/gone.py"), ("s2", 1, "beside.py")]))
def missing_names_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call in the code, a tracked file, another repository's path, a URL, a setting and an identifier like a file name
    are cleared."""
    make = spark.createDataFrame
    names = ["gone_call()", "here.kept_call()", "rpa.js", "Prisma.sql", "src/gone.py", "src/kept.py", "other/x.py", "http://x/y.py", "/etc/a.sh", "APP_DOMAIN", "SETUP.md", "tracked.py"]
    rows = [("s1", n) for n in names] + [("s2", "beside.py"), ("s2", "there.py"), ("s2", None)]
    files = make([("src/kept.py",), ("lib/tracked.py",), ("docs/sub/page.md",), ("docs/sub/there.py",)], "path string")
    return upkeep.missing_names(
        make(rows, "section_id string, mention string"), make([("s1", "d1"), ("s2", "d2")], "id string, path string"), make([("d1", "docs"), ("d2", "docs/sub")], "path string, folder string"), files,
        make([("kept_call", True), ("Prisma.sql", True), ("rpa.js", False)], "word string, source boolean"),
    )
