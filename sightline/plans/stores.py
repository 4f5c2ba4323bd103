"""Queries of sources and sinks: remote contents, workspaces, pruned folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import folder, ignore, remote, workspace
from ..sources.shared import shared_folder
from .base import FILES, as_files, query, table

_ROW_GROUP = 1 << 20
_PAGE_PATH = "'site' || CAST(page_id % 4 AS VARCHAR) || '/part' || CAST(page_id % 10 AS VARCHAR) || '/' || CAST(page_id AS VARCHAR) || '.html'"


def _answers(spark, sf_dir):
    """A recorded interface over ``pages``: a folder's answer lists it, a file's has its content; every 13th file's answer is missing."""
    n = F.col("page_id")
    site, part = F.concat(F.lit("site"), (n % 4).cast("string")), F.concat(F.lit("part"), (n % 10).cast("string"))
    pages = table(spark, sf_dir, "pages").select(n, site.alias("site"), F.concat_ws("/", site, part).alias("dir"), F.concat_ws("/", site, part, F.concat(n.cast("string"), F.lit(".html"))).alias("path"), F.coalesce("html", F.lit("")).alias("html"))
    # Every tenth file starts with a byte that is no UTF-8, every tenth isn't encoded.
    raw = F.when(n % 10 == 0, F.concat(F.unhex(F.lit("FF")), F.col("html").cast("binary"))).otherwise(F.col("html").cast("binary"))
    plain = n % 10 == 1
    entry = F.struct(F.lit("file").alias("type"), "path", F.when(~plain, "base64").alias("encoding"), F.when(plain, F.col("html")).otherwise(F.base64(raw)).alias("content"))
    files = pages.filter(n % 13 != 0).select("path", F.to_json(entry).alias("answer"))
    item = lambda kind, path: F.struct(F.lit(kind).alias("type"), F.col(path).alias("path"))
    listing = lambda rows, of, what: rows.groupBy(F.col(of).alias("path")).agg(F.to_json(F.array_sort(F.collect_list(what))).alias("answer"))
    dirs, sites = pages.select("site", "dir").distinct(), pages.select("site").distinct().withColumn("root", F.lit(""))
    return files.unionByName(listing(pages, "dir", item("file", "path"))).unionByName(listing(dirs, "site", item("dir", "dir"))).unionByName(listing(sites, "root", item("dir", "site")))


@query(f"""
SELECT {_PAGE_PATH} AS path, CASE WHEN page_id % 13 = 0 THEN NULL WHEN page_id % 10 = 0 THEN chr(65533) || coalesce(html, '') ELSE coalesce(html, '') END AS content,
  CASE WHEN page_id % 13 = 0 THEN 'status 404' END AS error FROM pages
""")
def remote_listing(spark, sf_dir):
    """S3 over recorded answers: folders listed one by one, files in batches of 20, files without an answer as rows with an error."""
    base = shared_folder(spark, "answers")
    # In order and in small row groups, so that a batch reads what it needs.
    _answers(spark, sf_dir).repartitionByRange("path").sortWithinPartitions("path").write.option("parquet.block.size", _ROW_GROUP).parquet(base)
    return remote.contents(spark, base, batch=20)


@query("""
SELECT o_orderkey AS compared, 'f' || CAST(l_linenumber AS VARCHAR) || '.py' AS path, '@@ ' || CAST(l_partkey AS VARCHAR) AS patch
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey % 4 <> 0 AND l_linenumber <> 3
""")
def diff_source(spark, sf_dir):
    """S4 over comparison answers, one an order; every fourth file is binary and has no patch, and third files have no name."""
    i = table(spark, sf_dir, "lineitem")
    name = F.when(F.col("l_linenumber") != 3, F.concat(F.lit("f"), F.col("l_linenumber").cast("string"), F.lit(".py")))
    patch = F.when(F.col("l_partkey") % 4 != 0, F.concat(F.lit("@@ "), F.col("l_partkey").cast("string")))
    answers = i.groupBy(F.col("l_orderkey").alias("compared")).agg(F.to_json(F.struct(F.collect_list(F.struct(name.alias("filename"), patch.alias("patch"))).alias("files"))).alias("answer"))
    met = answers.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("compared")), "compared")
    return remote.diff_files(met, F.col("answer"), "compared")


def _named(spark, sf_dir):
    """Files of runs (a source each), some of whose names can't be written."""
    k = F.col("doc_id") % 10
    odd = F.when(k == 0, F.concat(F.lit("/"), "path")).when(k == 1, F.concat(F.lit("a/../"), "path")).when(k == 2, F.concat("path", F.lit("\u0000.py"))).when(k == 3, F.concat(F.lit("./a//"), "path")).otherwise(F.col("path"))
    d = as_files(spark, sf_dir)
    return d.select(F.coalesce("source", F.lit("none")).alias("run"), F.col("doc_id").alias("ord"), odd.alias("path"), F.col("text").alias("content"))


_NAMED = f"""
{FILES.strip()},
w AS (SELECT coalesce(source, 'none') AS run, doc_id AS ord, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, path AS plain,
  CASE doc_id % 10 WHEN 0 THEN 'absolute path' WHEN 1 THEN 'parent folder in path' WHEN 2 THEN 'NUL in name' END AS bad FROM d),
o AS (SELECT run, list(struct_pack(id := ord, s := size) ORDER BY ord) AS fs FROM w WHERE bad IS NULL AND size <= 20000 GROUP BY 1),
t AS (SELECT run, list_reduce(list_prepend(struct_pack(total := CAST(0 AS BIGINT), taken := CAST([] AS BIGINT[])), list_transform(fs, lambda f: struct_pack(total := f.s, taken := [f.id]))),
  lambda a, f: CASE WHEN a.total + f.total <= 120000 THEN struct_pack(total := a.total + f.total, taken := list_concat(a.taken, f.taken)) ELSE a END).taken AS taken FROM o),
u AS (SELECT run, unnest(taken) AS ord FROM t),
v AS (SELECT w.*, coalesce(bad, CASE WHEN size > 20000 THEN 'file too large' WHEN u.ord IS NULL THEN 'run too large' END) AS fault FROM w LEFT JOIN u ON u.run = w.run AND u.ord = w.ord)
"""


@query(f"WITH {_NAMED} SELECT run, ord, size, fault FROM v")
def workspace_admission(spark, sf_dir):
    """S6, B3 with caps of 20 KB a file and 120 KB a run."""
    return workspace.admit(_named(spark, sf_dir), per_file=20_000, per_run=120_000).select("run", "ord", "size", "fault")


@query(f"""
WITH {_NAMED}, k AS (SELECT run || '/' || CASE WHEN ord % 10 = 3 THEN 'a/' ELSE '' END || plain AS path, size FROM v WHERE fault IS NULL)
SELECT path, size FROM k WHERE path NOT LIKE '%/vendor/%' AND (path NOT LIKE '%.js' OR path LIKE '%.min.js') AND NOT regexp_matches(path, '/de/[^/]*[02468][.][^/]*$')
""")
def workspace_scan(spark, sf_dir):
    """The admitted files are written to a workspace and scanned with ignore rules."""
    root = shared_folder(spark, "runs")
    workspace.write(workspace.admit(_named(spark, sf_dir), per_file=20_000, per_run=120_000).filter("fault IS NULL"), root)
    return folder.scan(spark, root, ignore=["# by folder, by name, by class", "vendor/", "*.js", "!*.min.js", "**/de/*[02468].*"], batch_files=200).select("path", "size")


@query(rf"""
WITH {FILES.strip()}
SELECT path, regexp_matches(path, '(^|/)(vendor|tests)/') AS by_folder,
  regexp_matches(path, '[.](py|js)$') AND NOT regexp_matches(path, '_test[.]py$') AS by_name,
  regexp_matches(path, '^auth/([^/]+/)*[^a-z/][^/]*[13579][.][^/]*$') AS by_class, regexp_matches(path, '^api/.+$') AS below
FROM d
""")
def ignore_rules(spark, sf_dir):
    """S2 over paths of a table: folders, names with an exception, a class below any depth, all below a folder."""
    p = F.col("path")
    rules = {"by_folder": ["vendor/", "tests/"], "by_name": ["*.py", "*.js", "!*_test.py"], "by_class": ["/auth/**/[!a-z]*[13579].*"], "below": ["api/**", "\\!none", "trailing  "]}
    return as_files(spark, sf_dir).select("path", *[ignore.ignored(p, lines).alias(name) for name, lines in rules.items()])


