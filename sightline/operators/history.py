"""History of runs: usage, dashboards, retention, accounts and permissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

USAGE = ["input_tokens", "output_tokens"]


def dashboard(scans: DataFrame, cutoff: Column, failed: str = "failed") -> DataFrame:
    """A1-A4: one row of counters over all scans and those since a cut-off, in one pass."""
    recent = F.col("started_at") >= cutoff
    return scans.agg(
        F.count(F.lit(1)).alias("n_scans"),
        F.count_if(recent).alias("n_recent"),
        F.count_if(F.col("status") == failed).alias("n_failed"),
        F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"),
        F.count_distinct(F.when(recent, F.col("user_id"))).alias("active_users"),
        F.count_distinct(F.when(F.col("findings") > 0, F.col("user_id"))).alias("users_at_risk"),
    )


def repos_at_risk(portal: DataFrame, ci: DataFrame, repo: str = "repo_url") -> DataFrame:
    """A4, F16: repositories with a critical or high finding, counted by channel and added (one in both counts twice)."""
    counts = [x.agg(F.count_distinct(F.when((F.col("critical") > 0) | (F.col("high") > 0), F.col(repo))).alias("n")) for x in (portal, ci)]
    return counts[0].unionByName(counts[1]).agg(F.sum("n").alias("repos_at_risk"))


def monthly_rollup(usage: DataFrame, keys: list[str], at: str, sums: list[str]) -> DataFrame:
    """By keys and month ("YYYY-MM"): sums, scan_count, last_updated."""
    month = F.date_format(at, "yyyy-MM").alias("year_month")
    return usage.groupBy(*keys, month).agg(*[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("scan_count"), F.max(at).alias("last_updated"))


def upsert_add(state: DataFrame, delta: DataFrame, keys: list[str], adds: list[str], latest: list[str] = ()) -> DataFrame:
    """State with the delta's counters added; new keys inserted, later times kept.

    A union and an aggregation: partial sums combine before the one shuffle.
    """
    cols = [*keys, *adds, *latest]
    return state.select(*cols).unionByName(delta.select(*cols)).groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in adds], *[F.max(c).alias(c) for c in latest])


def priced(usage: DataFrame, prices: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """Cost by a price list (keys, input_price, output_price per million); unknown models cost 0."""
    j = usage.join(prices, keys, "left")  # broadcast by Spark if its size allows
    cost = F.col("input_tokens") * F.coalesce("input_price", F.lit(0.0)) + F.col("output_tokens") * F.coalesce("output_price", F.lit(0.0))
    return j.withColumn("cost", F.round(cost / 1_000_000, digits)).drop("input_price", "output_price")


def latest(rows: DataFrame, keys: list[str], by: str, where: Column | None = None) -> DataFrame:
    """By keys the row with the largest ``by``; one aggregation, no sort."""
    rows = rows if where is None else rows.filter(where)
    whole = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(F.max_by(whole, by).alias("r")).select("r.*")


def page(rows: DataFrame, order: list, size: int, number: int) -> DataFrame:
    """One page and a row more, which tells whether there is a next one."""
    return rows.orderBy(*order).offset(size * number).limit(size + 1)


def newest(channels: list[DataFrame], at: str, tie: str, n: int) -> DataFrame:
    """The newest rows of each channel, then of all."""
    tops = [c.orderBy(F.desc(at), F.desc(tie)).limit(n) for c in channels]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out.orderBy(F.desc(at), F.desc(tie)).limit(n)


def last_across(first: DataFrame, second: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last time by keys over two channels and its channel; a tie is the first's."""
    both = first.select(*keys, at, F.lit(1).alias("c")).unionByName(second.select(*keys, at, F.lit(0).alias("c")))
    m = F.max(F.struct(at, "c"))
    return both.groupBy(*keys).agg(m.alias("m")).select(*keys, F.col(f"m.{at}").alias(at), F.when(F.col("m.c") == 1, "first").otherwise("second").alias("channel"))


def retain(scans: DataFrame, at: str, cutoff: Column) -> DataFrame:
    """U4: the rows that stay; rows without a time stay."""
    return scans.filter(F.col(at).isNull() | (F.col(at) >= cutoff))


def delete_by_channel(first: DataFrame, second: DataFrame, keys_gone: DataFrame, key: str, names: tuple[str, str] = ("portal", "ci")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first, second, told) after deleting keys, each from the first table that has it; told: key, channel, null where neither has."""
    gone = keys_gone.select(key).distinct()
    in_first = gone.join(first.select(key).distinct(), key, "left_semi").withColumn("channel", F.lit(names[0]))
    in_second = gone.join(first.select(key), key, "left_anti").join(second.select(key).distinct(), key, "left_semi").withColumn("channel", F.lit(names[1]))
    found = in_first.unionByName(in_second)
    told = gone.join(found, key, "left")
    return delete_keys(first, in_first, [key]), delete_keys(second, in_second, [key]), told


def delete_keys(rows: DataFrame, keys_gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows but those with a key in a list."""
    return rows.join(keys_gone.select(*keys).distinct(), keys, "left_anti")


def insert_absent(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, and the new ones whose key isn't there; of equal new keys one."""
    return rows.unionByName(new.dropDuplicates(keys).join(rows.select(*keys), keys, "left_anti").select(*rows.columns))


def provision(users: DataFrame, logins: DataFrame, protected: list[str], admin_group: str, now: Column) -> DataFrame:
    """Users (email, auth_provider, role, is_active, created_at, last_login_at, display_name) and those who log in first.

    logins: email, groups (array), auth_provider, name; of one e-mail's logins one is taken.  A
    protected e-mail or one in the admin group is an admin, an unknown provider is okta.
    """
    admin = F.col("email").isin(list(protected))
    if admin_group:
        admin = admin | F.coalesce(F.array_contains("groups", admin_group), F.lit(False))
    new = logins.filter("email <> ''").select(
        "email",
        F.when(F.coalesce("auth_provider", F.lit("unknown")) == "unknown", "okta").otherwise(F.col("auth_provider")).alias("auth_provider"),
        F.when(admin, "admin").otherwise("user").alias("role"),
        F.lit(True).alias("is_active"),
        now.alias("created_at"),
        now.alias("last_login_at"),
        F.col("name").alias("display_name"),
    )
    one = new.groupBy("email").agg(F.min(F.struct("role", "auth_provider", "is_active", "created_at", "last_login_at", "display_name")).alias("u")).select("email", "u.*")
    return insert_absent(users, one, ["email"])


def promote_users(users: DataFrame, seen: DataFrame, by: str | None = None, at: str | None = None) -> DataFrame:
    """Users (email, role, groups) after logins (email, is_admin, groups): promoted, never demoted; groups replaced where given.

    Of one e-mail's logins any may promote; the groups are the last given in order of
    ``by``, without that column the greatest given.  With ``at``, the logins' time, users have
    last_login_at, which becomes that of the last login.
    """
    groups = F.max_by("groups", F.when(F.col("groups").isNotNull(), F.col(by))) if by else F.max("groups")
    last = [F.max(at).alias("new_login")] if at else []
    s = seen.groupBy("email").agg(F.bool_or(F.coalesce("is_admin", F.lit(False))).alias("is_admin"), groups.alias("new_groups"), *last)
    admin = F.coalesce("is_admin", F.lit(False))
    timed = [F.coalesce("new_login", "last_login_at").alias("last_login_at")] if at else []
    old = users.join(s, "email", "left").select("email", F.when(admin, "admin").otherwise(F.col("role")).alias("role"), F.coalesce("new_groups", "groups").alias("groups"), *timed)
    new = s.join(users.select("email"), "email", "left_anti").select("email", F.when(F.col("is_admin"), "admin").otherwise("user").alias("role"), F.col("new_groups").alias("groups"), *([F.col("new_login").alias("last_login_at")] if at else []))
    return old.unionByName(new)


#: What an account can be asked to become: column, value, name of the audit row.
CHANGES = {"deactivate": ("is_active", "false", "user_deactivated"), "reactivate": ("is_active", "true", "user_reactivated"), "promote": ("role", "admin", "user_promoted"), "demote": ("role", "user", "user_demoted")}


def change_accounts(users: DataFrame, requests: DataFrame, protected: list[str]) -> tuple[DataFrame, DataFrame]:
    """(users after, requests with outcome): requests (request_id, email, actor, action, at) in order of request_id.

    users: email, role, is_active, reactivated_at.  Outcomes: not_found for an e-mail that has no
    account, own_role for one's own demotion, protected for deactivating or demoting a protected
    account, unknown for another action, else the name of the audit row.  The last change of each
    kind counts; a reactivation leaves its time.
    """
    known = users.select("email", F.lit(True).alias("__sl_known"))
    name = F.try_element_at(F.create_map(*[F.lit(x) for k, (*_, n) in CHANGES.items() for x in (k, n)]), F.col("action"))
    outcome = (
        F.when(F.col("__sl_known").isNull(), "not_found")
        .when(name.isNull(), "unknown")
        .when((F.col("action") == "demote") & F.col("email").eqNullSafe(F.col("actor")), "own_role")
        .when(F.col("email").isin(list(protected)) & F.col("action").isin("deactivate", "demote"), "protected")
        .otherwise(name)
    )
    told = requests.join(known, "email", "left").select(*requests.columns, outcome.alias("outcome"))
    done = told.filter(F.col("outcome") == name)
    last = lambda what, *actions: F.max_by(what, F.when(F.col("action").isin(*actions), F.col("request_id")))
    one = done.groupBy("email").agg(last(F.col("action") == "reactivate", "deactivate", "reactivate").alias("__sl_active"), last(F.col("action"), "promote", "demote").alias("__sl_role"), last(F.col("at"), "reactivate").alias("__sl_at"))
    role = F.when(F.col("__sl_role") == "promote", "admin").when(F.col("__sl_role") == "demote", "user")
    after = users.join(one, "email", "left").withColumns({"is_active": F.coalesce("__sl_active", "is_active"), "role": F.coalesce(role, F.col("role")), "reactivated_at": F.coalesce("__sl_at", "reactivated_at")})
    return after.select(*users.columns), told


def risky_repositories(scans: DataFrame, user: str, cutoff: Column, cap: int = 5) -> DataFrame:
    """Of a user's scans since ``cutoff``, by repository: total_critical, total_high, last_scan; the worst ``cap``, ties by name."""
    own = scans.filter((F.col("user_email") == user) & (F.col("started_at") >= cutoff))
    sums = own.groupBy("repo_url").agg(F.sum("critical").alias("total_critical"), F.sum("high").alias("total_high"), F.max("started_at").alias("last_scan"))
    return sums.orderBy(F.desc("total_critical"), F.desc("total_high"), "repo_url").limit(cap)


def rotate(tokens: DataFrame, rotated: DataFrame, now: Column) -> DataFrame:
    """Active tokens of the users listed (user, new_token) are closed and new ones added; of a user's new tokens the greatest."""
    r = rotated.groupBy("user").agg(F.max("new_token").alias("new_token"))
    closed = tokens.join(r, "user", "left").withColumn("revoked_at", F.when(F.col("new_token").isNotNull() & F.col("revoked_at").isNull(), now).otherwise(F.col("revoked_at"))).drop("new_token")
    new = r.select("user", F.col("new_token").alias("token"), now.alias("issued_at"), F.lit(None).cast("timestamp").alias("revoked_at"))
    return closed.unionByName(new.select(*closed.columns))


def set_flags(users: DataFrame, requests: DataFrame, protected: list[str], now: Column) -> tuple[DataFrame, DataFrame]:
    """(users after, audit rows): requests (email, actor, active) but for protected accounts and one's own demotion."""
    ok = requests.filter(~F.col("email").isin(protected) & ((F.col("email") != F.col("actor")) | F.col("active")))
    last = ok.groupBy("email").agg(F.max_by("active", "request_id").alias("wanted"))
    after = users.join(last, "email", "left").withColumn("is_active", F.coalesce("wanted", "is_active")).drop("wanted")
    audit = ok.select(F.when(F.col("active"), "user_reactivated").otherwise("user_deactivated").alias("event_type"), F.col("email").alias("user_email"), F.col("actor").alias("actor_email"), now.alias("at"))
    return after, audit


ADMIN_ACCESS = "admin_access"


def permitted(users: DataFrame, members: DataFrame, grants: DataFrame, permission: str, protected: list[str] = ()) -> DataFrame:
    """Users with a permission: through any group, protected ones always, and admins by role for ``admin_access`` alone."""
    holders = members.join(grants.filter(F.col("permission") == permission), "group_id", "left_semi").select("user_id")
    out = users.join(holders, "user_id", "left_semi").select("user_id")
    if permission == ADMIN_ACCESS:
        out = out.unionByName(users.filter("role = 'admin'").select("user_id"))
    if protected:
        out = out.unionByName(users.filter(F.col("user_id").isin(list(protected))).select("user_id"))
    return out.distinct()


def group_summary(groups: DataFrame, members: DataFrame, grants: DataFrame) -> DataFrame:
    """By group the number of members and the sorted permissions; one join each, no loop."""
    n = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_members"))
    p = grants.groupBy("group_id").agg(F.sort_array(F.collect_set("permission")).alias("permissions"))
    return groups.join(n, "group_id", "left").join(p, "group_id", "left").withColumns({"n_members": F.coalesce("n_members", F.lit(0)), "permissions": F.coalesce("permissions", F.array().cast("array<string>"))})


def token_outcome(requests: DataFrame, tokens: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Requests (request_id, token_id, token_hash) plus outcome, the first check that fails, or ok."""
    t = tokens.select("token_id", F.col("token_hash").alias("known_hash"), "user_id", "revoked_at", "expires_at")
    u = users.select("user_id", "is_active")
    j = requests.join(t, "token_id", "left").join(u, "user_id", "left")
    outcome = (
        F.when(F.col("known_hash").isNull(), "unknown")
        .when(F.col("revoked_at").isNotNull(), "revoked")
        .when(F.col("known_hash") != F.col("token_hash"), "mismatch")
        .when(F.col("expires_at") <= now, "expired")
        .when(F.col("is_active").isNull(), "no_user")
        .when(~F.col("is_active"), "inactive")
        .otherwise("ok")
    )
    return j.select(*requests.columns, outcome.alias("outcome"))


def identity_outcome(claims: DataFrame, key_ids: list[str], allowed: list[str], now: Column, skew: int = 30) -> DataFrame:
    """claims plus reason, the first check that fails, null if none does.

    In order: key (a known ``kid``), claims (``verified``: the signature and the claims under it,
    checked by whoever holds the key), expired (``exp`` within the skew), not_yet (``nbf``, if
    there is one), not_allowed (a prefix of the workflow that the job runs, or else was started
    from; an empty list is off), repository (there is one).
    """
    said = lambda c: F.nullif(F.col(c), F.lit(""))
    at = F.unix_timestamp(now)
    workflow = F.coalesce(said("job_workflow_ref"), said("workflow_ref"), F.lit(""))
    listed = F.exists(F.array(*map(F.lit, allowed)), lambda p: workflow.startswith(p)) if allowed else F.lit(True)
    checks = [
        ("key", F.col("kid").isin(key_ids)),
        ("claims", F.col("verified")),
        ("expired", F.col("exp") > at - skew),
        ("not_yet", F.coalesce(F.col("nbf"), at) <= at + skew),
        ("not_allowed", listed),
        ("repository", said("repository").isNotNull()),
    ]
    return claims.withColumn("reason", F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks]))


def resolve_identity(logins: DataFrame, users: DataFrame) -> DataFrame:
    """Logins (login_id, subject, email) with user_id by stable subject, else by e-mail; a local account with that e-mail conflicts."""
    by_subject = users.select(F.col("subject"), F.col("user_id").alias("u1"))
    by_email = users.select(F.col("email"), F.col("user_id").alias("u2"), F.col("is_local"))
    j = logins.join(by_subject, "subject", "left").join(by_email, "email", "left")
    clash = F.col("u1").isNull() & F.coalesce("is_local", F.lit(False))
    return j.select(*logins.columns, F.when(~clash, F.coalesce("u1", "u2")).alias("user_id"), clash.alias("conflict"))


def audit_filter(events: DataFrame, email_part: str | None = None, event_type: str | None = None, known: list[str] | None = None) -> DataFrame:
    """substring of the e-mail in any case, and one event type; an unknown type is an error."""
    if event_type is not None and known is not None and event_type not in known:
        raise ValueError(f"unknown event type: {event_type}")
    out = events if email_part is None else events.filter(F.col("user_email").ilike(f"%{email_part}%"))
    return out if event_type is None else out.filter(F.col("event_type") == event_type)


def enclosing(lines: DataFrame, keys: list[str], at: str, name: Column, back: int | None = None) -> DataFrame:
    """Lines plus enclosing, the last name at or above the line, within ``back`` lines if given."""
    w = W.partitionBy(*keys).orderBy(at).rowsBetween(W.unboundedPreceding if back is None else -(back - 1), 0)
    return lines.withColumn("enclosing", F.last(name, ignorenulls=True).over(w))


def settings_row(raw: DataFrame) -> DataFrame:
    """parallelism clamped to 1-16, retention in digits or null, blank flags false."""
    return raw.withColumns({"parallelism": F.least(F.greatest(F.col("parallelism"), F.lit(1)), F.lit(16)), "retention_days": F.when(F.col("retention_days").rlike("^[0-9]+$"), F.col("retention_days").cast("int")), "enabled": F.coalesce(F.lower(F.trim("enabled")).isin("1", "on", "true", "yes"), F.lit(False))})


def id_list(value: Column) -> Column:
    """``source:uuid`` items of a comma-separated list; malformed items are left out."""
    items = F.transform(F.split(value, ","), lambda x: F.trim(x))
    return F.filter(items, lambda x: x.rlike("(?i)^[a-z]+:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"))


def token_list(tokens: DataFrame, status: str | None = None, active_only: bool = False, email_part: str | None = None, cap: int = 500) -> DataFrame:
    """The newest ``cap`` tokens, active, revoked or all; an unknown status is none, the older flag means active."""
    active = active_only or status == "active"
    out = tokens
    if active:
        out = out.filter(F.col("revoked_at").isNull())
    elif status == "revoked":
        out = out.filter(F.col("revoked_at").isNotNull())
    if email_part:
        out = out.filter(F.col("user_email").ilike(f"%{email_part}%"))
    return out.orderBy(F.desc("issued_at"), F.desc("token_id")).limit(cap)


def resolved_flags(scopes: DataFrame, configs: DataFrame, keys: list[str], by: str, environment: dict[str, bool], defaults: dict[str, bool]) -> DataFrame:
    """scopes with each flag of ``defaults``: of the scope's latest config row, else of the environment, else the default.

    A config row decides all its flags; one that is null there is off.
    """
    last = latest(configs, keys, by).select(*keys, F.lit(True).alias("__sl_row"), *[F.coalesce(F.col(f), F.lit(False)).alias(f) for f in defaults])
    j = scopes.join(last, keys, "left")
    return j.withColumns({f: F.when(F.col("__sl_row"), F.col(f)).otherwise(F.lit(environment.get(f, d))) for f, d in defaults.items()}).drop("__sl_row")


def report_rows(portal: DataFrame, ci: DataFrame) -> DataFrame:
    """Both channels' rows (scan_id, started_at, html_report) with source and has_report, for :func:`page`."""
    both = [x.select(F.lit(name).alias("source"), "scan_id", "started_at", (F.coalesce("html_report", F.lit("")) != "").alias("has_report")) for name, x in (("portal", portal), ("ci", ci))]
    return both[0].unionByName(both[1])


def audit_rows(events: DataFrame, metadata: list[str], now: Column) -> DataFrame:
    """Rows to append: (event_type, user_email, actor_email, at, metadata); the metadata columns as JSON, without nulls, null if nothing is left."""
    json = F.to_json(F.struct(*metadata))
    return events.select("event_type", "user_email", "actor_email", now.alias("at"), F.nullif(json, F.lit("{}")).alias("metadata"))


def run_rows(runs: DataFrame, now: Column, ci: bool = False) -> dict[str, DataFrame]:
    """What finished runs add to the history: scans, monthly and, but for CI, usage and audit.

    runs: scan_id, user_email, finished_at, status, provider, model, input_tokens,
    output_tokens, findings.  Runs without a user leave nothing.  CI runs are always ok.
    ``monthly`` holds increments, to be added by :func:`upsert_add`.
    """
    runs = runs.filter(F.coalesce("user_email", F.lit("")) != "")
    status = F.lit("ok") if ci else F.col("status")
    rows = {"scans": runs.select("scan_id", "user_email", "finished_at", status.alias("status"), "findings")}
    rows["monthly"] = monthly_rollup(runs, ["user_email", "provider", "model"], "finished_at", USAGE)
    if not ci:
        rows["usage"] = runs.select("scan_id", "provider", "model", *USAGE)
        done = runs.select(F.lit("scan_ok").alias("event_type"), "user_email", F.lit(None).cast("string").alias("actor_email"), "scan_id", "status", "findings")
        rows["audit"] = audit_rows(done, ["scan_id", "status", "findings"], now)
    return rows


def publish(rows: dict[str, DataFrame], folder: str, batch: str) -> None:
    """Append frames as one batch of the shared folder: tables first, the batch's line of the manifest last.

    A batch that broke off is never read; the same batch written again replaces its files.
    """
    for name, frame in rows.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
    spark = next(iter(rows.values())).sparkSession
    spark.createDataFrame([(n,) for n in rows], "name string").write.mode("overwrite").parquet(f"{folder}/manifest/batch={batch}")


def published(spark, folder: str, name: str) -> DataFrame:
    """The rows of a table from the batches whose manifest is written; batch is a column."""
    done = spark.read.parquet(f"{folder}/manifest").filter(F.col("name") == name).select(F.col("batch").cast("string"))
    rows = spark.read.parquet(f"{folder}/{name}").withColumn("batch", F.col("batch").cast("string"))
    return rows.join(done, "batch", "left_semi")
