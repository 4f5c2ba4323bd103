"""Context around a finding: lines, functions, callers, routes, snippets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import caller_test_file, suffix
from ..functions.text import split_lines
from .access import guards, ownership_checks

#: Function definitions by file suffix: group 1 is the name.
DEFINITIONS = {
    ".py": r"^\s*(?:async\s+)?def\s+(\w+)\s*\(",
    ".js": r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(",
    ".ts": r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(",
    ".go": r"^\s*func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(",
}
CALL = r"(?U)\b(\w+)\s*\("

#: The shapes of routes that are known. (framework, suffixes, pattern, groups of path, method and handler).
#: Method 0: GET or as listed, -1: ANY.  Handler 0: the next function below, -1: the first argument that is a name.
PY, JS = [".py"], [".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs"]
ROUTES = [
    ("flask", PY, r"(?i)@(?:\w+\.)?route\s*\(\s*['\"]([^'\"]+)['\"]", 1, 0, 0),
    ("fastapi", PY, r"(?i)@(?:\w+\.)?(get|post|put|delete|patch|head|options|trace)\s*\(\s*['\"]([^'\"]+)['\"]", 2, 1, 0),
    ("aiohttp", PY, r"(?i)\.add_route\s*\(\s*['\"](\w+)['\"]\s*,\s*['\"]([^'\"]+)['\"]\s*,\s*(\w+)", 2, 1, 3),
    ("aiohttp", PY, r"(?i)\.add_(get|post|put|delete|patch|head)\s*\(\s*['\"]([^'\"]+)['\"]\s*,\s*(\w+)", 2, 1, 3),
    ("aiohttp", PY, r"(?i)@routes\.(get|post|put|delete|patch|head)\s*\(\s*['\"]([^'\"]+)['\"]", 2, 1, 0),
    ("django", PY, r"(?i)(?:re_)?path\s*\(\s*r?['\"]([^'\"]+)['\"]\s*,\s*(\w[\w.]*)", 1, -1, 2),
    ("express", JS, r"(?i)(?:app|router)\.(get|post|put|delete|patch|head|options|all)\s*\(\s*['\"`]([^'\"`]+)['\"`]", 2, 1, -1),
    ("gin", [".go"], r"(?i)\w+\.(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|Any)\s*\(\s*\"([^\"]+)\"\s*,\s*(\w+)", 2, 1, 3),
]
LISTED_METHODS = r"(?i)methods\s*=\s*\[([^\]]+)\]"
NEXT_FUNCTION = r"(?:async\s+)?def\s+(\w+)\s*\("
NAMED_ARGUMENT = r",\s*(?:async\s+)?(?:function\s+)?(\w+)\s*[,)\n{]"


def lines_of(files: DataFrame, path: str = "path", content: str = "content", keep: list[str] = ()) -> DataFrame:
    """One row a line: path, line (from 1), text."""
    return files.select(*keep, F.col(path).alias("path"), F.posexplode(split_lines(F.col(content))).alias("pos", "text")).withColumn("line", F.col("pos") + 1).drop("pos")


def definition(path: Column, text: Column) -> Column:
    """The name that a line defines in its file's language, null if none."""
    out = F.lit(None).cast("string")
    for end, pattern in DEFINITIONS.items():
        out = F.when(suffix(path) == end, F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))).otherwise(out)
    return out


def functions_of(lines: DataFrame, back: int | None = 50, below: int = 6) -> DataFrame:
    """Lines plus function (last definition at or above, within ``back`` lines) and next_function (first within ``below`` lines under)."""
    w = W.partitionBy("path").orderBy("line")
    name = definition(F.col("path"), F.col("text"))
    up = w.rowsBetween(W.unboundedPreceding if back is None else -(back - 1), 0)
    return lines.withColumn("__d", name).withColumns({"function": F.last("__d", True).over(up), "next_function": F.first("__d", True).over(w.rowsBetween(1, below))}).drop("__d")


def callers(functions: DataFrame, lines: DataFrame, cap: int = 5) -> DataFrame:
    """For each function (name) the first lines of non-test files that call it: name, path, line, text.

    Calls are cut out of the lines once and joined on the name; definitions don't count.
    """
    calls = lines.filter(~caller_test_file(F.col("path"))).withColumn("name", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(CALL), F.lit(1)))))
    calls = calls.filter(~F.coalesce(definition(F.col("path"), F.col("text")) == F.col("name"), F.lit(False)))
    w = W.partitionBy("name").orderBy("path", "line")
    return calls.join(functions.select("name").distinct(), "name").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= cap).drop("rn")


#: Characters of needles that a task searches for at once: what one automaton may hold.
PASS_CHARS = 2_000_000


def contained_passages(needles: DataFrame, texts: DataFrame, needle_id: str, needle: str, text_id: str, text: str, pass_chars: int = PASS_CHARS) -> DataFrame:
    """J11's containment: (needle_id, text_id) where the text contains the needle, both lower-cased.

    One automaton finds all needles, of any length, while it reads a text once.  Needles are
    gathered for it up to ``pass_chars`` characters, which bounds what is broadcast and what a
    task holds; more needles are searched for in further passes over the texts.  Empty and null
    needles and texts contain nothing and are nowhere; equal needles are told by their ids.
    """
    n = needles.select(F.col(needle_id).alias("id"), F.lower(needle).alias("needle")).filter("needle <> ''")
    forms = n.select("needle").distinct()
    chars = forms.agg(F.sum(F.length("needle"))).first()[0] or 0
    t = texts.select(F.col(text_id), F.lower(text).alias("body"))
    kind = t.schema[0].dataType.simpleString()
    passes = max(1, -(-chars // pass_chars))
    found = None
    for k in range(passes):
        # Each pass has its part of the needles by hash; a part is checked again before it is sent.
        part = [r.needle for r in forms.filter(F.pmod(F.xxhash64("needle"), F.lit(passes)) == k).toLocalIterator()] if passes > 1 else [r.needle for r in forms.collect()]
        for group in _groups(part, 2 * pass_chars):
            sent = texts.sparkSession.sparkContext.broadcast(group)
            hits = t.mapInArrow(_searcher(sent), f"`{text_id}` {kind}, needle string")
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = t.select(text_id, F.col("body").alias("needle")).limit(0)
    return n.join(found, "needle").select(F.col("id").alias(needle_id), text_id)


def _groups(needles: list[str], most: int) -> Iterator[list[str]]:
    """The needles in lists of at most ``most`` characters, unless one needle is longer."""
    group, chars = [], 0
    for x in needles:
        if group and chars + len(x) > most:
            yield group
            group, chars = [], 0
        group.append(x)
        chars += len(x)
    if group:
        yield group


def _searcher(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for x in sent.value:
            automaton.add_word(x, x)
        automaton.make_automaton()
        for b in batches:
            rows, hits = [], []
            for i, body in enumerate(b.column(1)):
                seen = {x for _, x in automaton.iter(body.as_py() or "")}
                rows += [i] * len(seen)
                hits += seen
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(hits, pa.string())], [b.schema.names[0], "needle"])

    return search


def routes(lines: DataFrame, below: int = 6) -> DataFrame:
    """Path, line, framework, route, method, handler.

    One row for each framework whose shape a line has and each method it lists; of the
    shapes of one framework the first counts.  A handler is the one named, else the first
    function in the ``below`` lines under it (``<unknown>`` if none), for inline functions
    ``<anonymous>``.
    """
    w = W.partitionBy("path").orderBy("line")
    name = F.nullif(F.regexp_extract("text", NEXT_FUNCTION, 1), F.lit(""))
    found = lines.withColumn("__f", name).withColumn("__next", F.coalesce(F.first("__f", True).over(w.rowsBetween(1, below)), F.lit("<unknown>")))
    text, shapes = F.col("text"), {}
    for framework, ends, pattern, route, method, handler in ROUTES:
        listed = F.filter(F.transform(F.split(F.regexp_extract(text, LISTED_METHODS, 1), ","), lambda m: F.upper(F.regexp_replace(m, r"^[\s'\"]+|[\s'\"]+$", ""))), lambda m: m != "")
        methods = F.array(F.upper(F.regexp_extract(text, pattern, method))) if method > 0 else F.array(F.lit("ANY")) if method else F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("GET")))
        rest = F.regexp_replace(text, "^.*?" + pattern, "")
        by = F.regexp_extract(text, pattern, handler) if handler > 0 else F.col("__next") if not handler else F.coalesce(F.nullif(F.regexp_extract(rest, NAMED_ARGUMENT, 1), F.lit("")), F.lit("<anonymous>"))
        hit = F.when(suffix(F.col("path")).isin(ends) & text.rlike(pattern), F.struct(F.lit(framework).alias("framework"), F.regexp_extract(text, pattern, route).alias("route"), methods.alias("methods"), by.alias("handler")))
        shapes[framework] = F.coalesce(shapes[framework], hit) if framework in shapes else hit
    one = found.select("path", "line", F.explode(F.array_compact(F.array(*shapes.values()))).alias("r"))
    return one.select("path", "line", "r.framework", "r.route", F.explode("r.methods").alias("method"), "r.handler")


#: Calls of interest by kind, first kind counts, and words that look like calls.
CALLEES = [
    ("auth_check", r"(?iU)\b(has_permission|can_\w+|require_\w+|check_permission|is_authorized|is_owner|verify_\w+|assert_permission|authorize)\s*\("),
    ("ownership_helper", r"(?iU)\b(get_user|find_\w+_by_id|get_\w+_by_id|current_user|get_current_user|get_owner|get_resource_owner|get_tenant)\s*\("),
    ("db_query", r"(?iU)\b(execute|query|fetchone|fetchall|cursor|find_by|get_or_404|get_object_or_404|filter_by|select|insert|update|delete|raw|execute_query)\s*\("),
    ("other", r"(?U)\b(\w{3,})\s*\("),
]
NOT_CALLED = ["if", "for", "while", "def", "class", "return", "import", "from", "with", "not", "and", "or", "in", "is", "str", "int", "len", "print", "True", "False", "None"]
MAX_CALLERS, MAX_CALLEES, MAX_ROUTES, MAX_GUARDS, MAX_OWNERSHIP, MAX_SNIPPET = 5, 10, 5, 10, 10, 30


def callees(snippet: Column, cap: int | None = MAX_CALLEES) -> Column:
    """array<struct<name, kind>> of what a snippet calls, each name under its first kind, by kind and then name."""
    raw = F.struct(*[F.array_sort(F.array_distinct(F.regexp_extract_all(snippet, F.lit(pattern), F.lit(1)))).alias(kind) for kind, pattern in CALLEES])

    def by_kind(found):
        kinds = [kind for kind, _ in CALLEES]
        parts = []
        for i, kind in enumerate(kinds):
            names = F.array_except(found[kind], F.concat(*[found[k] for k in kinds[:i]])) if i else found[kind]
            names = F.filter(names, lambda n: ~n.isin(NOT_CALLED)) if kind == "other" else names
            parts.append(F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind"))))  # noqa: B023
        return F.concat(*parts)

    # Bound once, so that each pattern runs once; a text without a parenthesis calls nothing.
    bound = F.when(snippet.contains("("), F.get(F.transform(F.array(raw), by_kind), 0))
    out = F.coalesce(bound, F.array().cast("array<struct<name:string,kind:string>>"))
    return F.slice(out, 1, cap) if cap else out


def snippet(lines: Column, start: Column, end: Column, scanner_only: Column) -> Column:
    """The lines around a finding: 8 on each side, 14 for scanners' own, at most 30; without a start the first 30."""
    wide = F.when(scanner_only, F.lit(14)).otherwise(F.lit(8))
    first = F.greatest(start - wide + 1, F.lit(1))
    last = F.coalesce(F.nullif(end, F.lit(0)), start) + wide
    n = F.least(last - first + 1, F.lit(MAX_SNIPPET))
    part = F.when(F.coalesce(start, F.lit(0)) != 0, F.slice(lines, first.cast("int"), F.greatest(n, F.lit(0)).cast("int"))).otherwise(F.slice(lines, 1, MAX_SNIPPET))
    return F.array_join(part, "\n")


def _capped(rows: DataFrame, key: str, cap: int, columns: list[str], name: str) -> DataFrame:
    """By key the first rows in line order as one array; the cap is applied before rows meet."""
    w = W.partitionBy(key).orderBy(*columns)
    top = rows.withColumn("__sl_rn", F.row_number().over(w)).filter(F.col("__sl_rn") <= cap)
    return top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def bundles(candidates: DataFrame, files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Candidates (candidate_ord, file, line_start, line_end, sources) with snippet, callees, routes, guards and ownership of their file.

    A file without routes gets the first routes of the snapshot, by path and line (a list
    of fixed length).  A candidate whose file is missing has an empty bundle.  A path is
    once in ``files``.
    """
    lines = lines_of(files, path, content)
    found = routes(lines)
    own = _capped(found, "path", MAX_ROUTES, ["line", "framework", "method", "route", "handler"], "own")
    tagged = found.select("path", "line", "framework", "method", "route", "handler").orderBy("path", "line", "framework", "method").limit(MAX_ROUTES)
    others = tagged.agg(F.array_sort(F.collect_list(F.struct(*tagged.columns))).alias("others"))  # at most MAX_ROUTES rows
    g = _capped(guards(lines), "path", MAX_GUARDS, ["line", "kind", "name"], "guards")
    o = _capped(ownership_checks(lines), "path", MAX_OWNERSHIP, ["line", "pattern", "identifier", "current_user_derived"], "ownership")
    text = files.select(F.col(path).alias("path"), split_lines(F.col(content)).alias("__sl_lines"))
    j = candidates.withColumn("path", F.col("file"))
    for part in (text, own, g, o):
        j = j.join(part, "path", "left")
    cut = snippet(F.col("__sl_lines"), F.col("line_start"), F.col("line_end"), ~F.array_contains("sources", "llm"))
    j = j.withColumn("snippet", F.coalesce(cut, F.lit("")))
    with_path = F.transform("own", lambda r: F.struct(F.col("path").alias("path"), r["line"].alias("line"), r["framework"].alias("framework"), r["method"].alias("method"), r["route"].alias("route"), r["handler"].alias("handler")))
    return j.withColumns(
        {
            "callees": callees(F.col("snippet")),
            "routes": F.when(F.col("__sl_lines").isNull(), F.array().cast("array<struct<path:string,line:int,framework:string,method:string,route:string,handler:string>>")).otherwise(F.coalesce(with_path, others.scalar())),
            "guards": F.coalesce("guards", F.array().cast("array<struct<line:int,kind:string,name:string>>")),
            "ownership": F.coalesce("ownership", F.array().cast("array<struct<line:int,pattern:string,identifier:string,current_user_derived:boolean>>")),
        }
    ).drop("path", "__sl_lines", "own")
