"""Catalogue maintenance: registrations, accounts, fetch outcomes, deletes, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintmill.functions.repo_ref import html_url, parse_repo_ref
from lintmill.operators.joins import first_per_key, rows_not_of, spread_join
from lintmill.schemas import IDENTITY, MAX_LENGTHS, TABLES, VALUE_DOMAINS
from lintmill.session import written


def stable_id(*parts: Column | str) -> Column:
    """An id made from the row itself, so that a repeated task makes the same one."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def identified(rows: DataFrame, name: str) -> DataFrame:
    """The rows of a table with an ``id``: those that have none get one from what tells them apart.

    A repeated task, and a repeated job, makes the same ids. Rows that nothing tells apart are
    numbered, so no two rows of a run have one id. The rows are moved as they are; the texts that
    tell them apart, longer than the rows, are made where they are numbered.
    """
    old = F.col("id") if "id" in rows.columns else F.lit(None).cast("string")
    others = [c for c in rows.columns if c != "id"]
    every = {"ignoreNullFields": "false"}
    keys = [c for c in IDENTITY[name] if c in others]
    # Spark compares fractions in another form than it deals them by; the others are enough to deal by.
    dealt = [c for c in keys if dict(rows.dtypes)[c] not in ("float", "double")]
    marked = rows.repartition(*dealt).withColumn("_key", F.sha2(F.to_json(F.struct(*keys), every), 256))
    # The key alone tells the rows apart; the columns before it say that they lie together already.
    numbers = Window.partitionBy(*dealt, "_key").orderBy(F.to_json(F.struct(*others), every))
    number = F.row_number().over(numbers).cast("string")
    return marked.withColumn("id", F.coalesce(old, stable_id(F.lit(name), F.col("_key"), number))).drop("_key")


# ---- repositories -----------------------------------------------------------


def register_repositories(requests: DataFrame, repositories: DataFrame) -> DataFrame:
    """Decide requests (user_id, seq, url, branch): registered, duplicate or invalid.

    The first request for a repository wins; it is found by an aggregation per
    repository, so a name that everybody asks for is reduced inside the tasks.
    """
    ref = parse_repo_ref(F.col("url"))
    length = F.length("url")
    too_long = (length < 3) | (length > 512) | (F.length("branch") > 255)
    parsed = requests.withColumn("_ref", ref).select(
        "user_id",
        "seq",
        "branch",
        F.col("_ref.owner").alias("owner"),
        F.col("_ref.name").alias("name"),
        F.when(too_long, "invalid_length").otherwise(F.col("_ref.error")).alias("error"),
    )
    keys = ["user_id", "owner", "name"]
    # Parsed once: the requests are looked at three times.
    parsed = written(parsed, "parsed_requests")
    valid = parsed.where(F.col("error").isNull())
    known = repositories.select(*keys).distinct().withColumn("_known", F.lit(True))
    firsts = valid.groupBy(*keys).agg(F.min("seq").alias("_first"))
    decided = firsts.join(known, keys, "left")
    judged = spread_join(valid, decided, keys, ["seq"], "inner").withColumn(
        "outcome",
        F.when(F.col("_known").isNull() & (F.col("seq") == F.col("_first")), "registered").otherwise(
            "duplicate"
        ),
    )
    rejected = parsed.where(F.col("error").isNotNull()).withColumn("outcome", F.lit("invalid"))
    columns = ["user_id", "seq", "owner", "name", "branch", "outcome", "error"]
    return judged.select(*columns).unionByName(rejected.select(*columns))


def new_repositories(decided: DataFrame, at: Column) -> DataFrame:
    """Rows to append for the registered requests, in state ``cloning``."""
    return decided.where(F.col("outcome") == "registered").select(
        stable_id("user_id", "owner", "name").alias("id"),
        "user_id",
        html_url(F.col("owner"), F.col("name")).alias("url"),
        "owner",
        "name",
        F.lit(None).cast("string").alias("default_branch"),
        F.lit(None).cast("string").alias("local_path"),
        F.lit("cloning").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit(None).cast("timestamp").alias("cloned_at"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )


def apply_fetch_outcomes(repositories: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Merge fetch results (repository_id, ok, local_path, default_branch, message, at).

    The last result of a repository counts.
    """
    last = outcomes.groupBy(F.col("repository_id").alias("id")).agg(
        F.max(F.struct("at", "ok", "local_path", "default_branch", "message")).alias("_o")
    )
    joined = repositories.join(last, "id", "left")
    done, ok = F.col("_o").isNotNull(), F.col("_o.ok")

    def pick(column: str, on_success: Column, on_failure: Column) -> Column:
        return (
            F.when(done & ok, on_success)
            .when(done & ~ok, on_failure)
            .otherwise(F.col(column))
            .alias(column)
        )

    changed = {
        "status": pick("status", F.lit("ready"), F.lit("failed")),
        "local_path": pick("local_path", F.col("_o.local_path"), F.col("local_path")),
        "default_branch": pick("default_branch", F.col("_o.default_branch"), F.col("default_branch")),
        "cloned_at": pick("cloned_at", F.col("_o.at"), F.col("cloned_at")),
        "error_message": pick("error_message", F.lit(None).cast("string"), F.col("_o.message")),
        "updated_at": pick("updated_at", F.col("_o.at"), F.col("_o.at")),
    }
    return joined.select(*[changed.get(c, F.col(c)) for c in repositories.columns])


# ---- accounts ---------------------------------------------------------------


def with_primary_email(profiles: DataFrame) -> DataFrame:
    """Replace ``email`` by the public one, else the first primary verified entry of
    ``emails``; null when there is none and the profile is to be rejected."""
    usable = F.filter(
        F.col("emails"), lambda e: e["primary"] & e["verified"] & (F.coalesce(e["email"], F.lit("")) != "")
    )
    chosen = F.coalesce(F.nullif(F.col("email"), F.lit("")), F.get(usable, F.lit(0))["email"])
    return profiles.withColumn("email", F.lower(chosen))


def resolve_accounts(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """Match profiles (github_id, username, email, full_name, avatar_url, seq) to users.

    Returns one row per touched account: action (update, link, create), user_id and
    the values the account has afterwards.  Matching looks at ``users`` as given.
    A profile without an address touches nothing: each comes back with the action
    ``rejected`` and no user, also if its github_id is known.
    A profile that comes twice counts once, the last time; several profiles with
    one e-mail address end in one account that holds the last one's link and the
    first name given.

    No two accounts end with one address: a known profile that asks for the address of
    another user, or for one that a later profile of the batch asks for as well, comes back
    as ``conflict`` and changes nothing, and so does an unknown profile whose address an
    update keeps or takes.
    """
    addressed = F.coalesce(F.col("email"), F.lit("")) != ""
    latest = first_per_key(profiles.where(addressed), ["github_id"], [F.desc("seq")]).drop("_rank")
    by_id = users.where(F.col("github_id").isNotNull()).select(
        "github_id", F.col("id").alias("_id"), F.col("full_name").alias("_name")
    )
    matched = latest.join(by_id, "github_id", "left")
    name = F.nullif(F.col("full_name"), F.lit(""))
    holders = users.select(F.lower("email").alias("_email"), F.col("id").alias("_holder"))
    asked = matched.where(F.col("_id").isNotNull()).withColumn("_email", F.lower("email")).join(holders, "_email", "left")
    free = F.coalesce(F.col("_holder") == F.col("_id"), F.col("_holder").isNull())
    # Of several that ask for a free address the last gets it; its holder, if any, is alone.
    asked = asked.join(
        asked.where(free).groupBy("_email").agg(F.max("seq").alias("_wins")), "_email", "left"
    ).withColumn("_granted", free & (F.col("seq") == F.col("_wins")))
    updated = asked.where("_granted").select(
        F.lit("update").alias("action"),
        F.col("_id").alias("user_id"),
        "email",
        F.coalesce(name, F.col("_name")).alias("full_name"),
        "github_id",
        F.col("username").alias("github_username"),
        "avatar_url",
        F.lit("github").alias("auth_provider"),
    )
    # The rest is folded per address: last link, first name.
    taken = asked.where("_granted").select("_email").distinct()
    unknown = matched.where(F.col("_id").isNull()).withColumn("_email", F.lower("email"))
    rest = unknown.join(taken, "_email", "left_anti")
    folded = rest.groupBy("_email").agg(
        F.max(F.struct("seq", "github_id", "username", "avatar_url")).alias("_last"),
        F.min(F.when(name.isNotNull(), F.struct(F.col("seq").alias("seq"), name.alias("name")))).alias("_first"),
    )
    by_email = users.select(
        F.col("email").alias("_email"),
        F.col("id").alias("_id"),
        F.col("full_name").alias("_name"),
        F.col("auth_provider").alias("_provider"),
    )
    untouched = by_email.join(
        updated.select(F.col("user_id").alias("_id")).distinct(), "_id", "left_anti"
    )
    merged = folded.join(untouched, "_email", "left")
    exists = F.col("_id").isNotNull()
    provider = F.when(exists & (F.col("_provider") != "local"), F.col("_provider")).otherwise("github")
    others = merged.select(
        F.when(exists, "link").otherwise("create").alias("action"),
        F.coalesce("_id", stable_id("_email")).alias("user_id"),
        F.col("_email").alias("email"),
        F.coalesce(F.nullif(F.col("_name"), F.lit("")), F.col("_first.name")).alias("full_name"),
        F.col("_last.github_id").alias("github_id"),
        F.col("_last.username").alias("github_username"),
        F.col("_last.avatar_url").alias("avatar_url"),
        provider.alias("auth_provider"),
    )
    def untouched_by(profiles: DataFrame, action: str) -> DataFrame:
        nothing = F.lit(None).cast("string")
        return profiles.select(
            F.lit(action).alias("action"),
            nothing.alias("user_id"),
            nothing.alias("email"),
            F.nullif(F.col("full_name"), F.lit("")).alias("full_name"),
            "github_id",
            F.col("username").alias("github_username"),
            "avatar_url",
            nothing.alias("auth_provider"),
        )

    conflicts = [untouched_by(asked.where(~F.col("_granted")), "conflict"), untouched_by(unknown.join(taken, "_email", "left_semi"), "conflict")]
    return _union([updated, others, untouched_by(profiles.where(~addressed), "rejected"), *conflicts])


def merge_accounts(users: DataFrame, resolved: DataFrame, at: Column) -> DataFrame:
    """The ``users`` table after the decisions of ``resolve_accounts``.

    Accounts that were updated or linked get their new values, created ones are
    added without a password, rejected profiles leave no trace.
    """
    changed = ["email", "full_name", "github_id", "github_username", "avatar_url", "auth_provider"]
    touched = resolved.where(F.col("action").isin("update", "link", "create"))
    new = touched.select(F.col("user_id").alias("id"), F.struct("action", *changed).alias("_new"))
    joined = users.join(new.where(F.col("_new.action") != "create"), "id", "left")
    hit = F.col("_new").isNotNull()
    kept = {c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in changed}
    kept["updated_at"] = F.when(hit, at).otherwise(F.col("updated_at"))
    old = joined.select(*[kept.get(c, F.col(c)).alias(c) for c in users.columns])
    added = {c: F.col(f"_new.{c}") for c in changed}
    added |= {"id": F.col("id"), "hashed_password": F.lit(None).cast("string"), "is_active": F.lit(True)}
    added |= {"created_at": at, "updated_at": at}
    created = new.where(F.col("_new.action") == "create")
    return old.unionByName(created.select(*[added[c].alias(c) for c in users.columns]))


def new_users(decided: DataFrame, at: Column) -> DataFrame:
    """Rows to append for the sign-ups (with hashed_password) that were registered."""
    nothing = F.lit(None).cast("string")
    return decided.where(F.col("outcome") == "registered").select(
        stable_id("email").alias("id"),
        "email",
        "hashed_password",
        "full_name",
        F.lit(None).cast("long").alias("github_id"),
        nothing.alias("github_username"),
        nothing.alias("avatar_url"),
        F.lit("local").alias("auth_provider"),
        F.lit(True).alias("is_active"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )


def register_accounts(users: DataFrame, requests: DataFrame) -> DataFrame:
    """Decide sign-ups (seq, email, ...): registered, duplicate_email, or rejected for want of an address."""
    every = requests.withColumn("email", F.nullif(F.lower("email"), F.lit("")))
    lowered = every.where(F.col("email").isNotNull())
    rejected = every.where(F.col("email").isNull()).withColumn("outcome", F.lit("rejected"))
    taken = users.select("email").distinct().withColumn("_taken", F.lit(True))
    firsts = lowered.groupBy("email").agg(F.min("seq").alias("_first")).join(taken, "email", "left")
    judged = spread_join(lowered, firsts, ["email"], ["seq"], "inner")
    free = F.col("_taken").isNull() & (F.col("seq") == F.col("_first"))
    outcome = F.when(free, "registered").otherwise("duplicate_email").alias("outcome")
    return judged.select(*requests.columns, outcome).unionByName(rejected.select(*requests.columns, "outcome"))


# ---- deletes ----------------------------------------------------------------


def cascade_delete(
    tables: dict[str, DataFrame],
    users: DataFrame | None = None,
    repositories: DataFrame | None = None,
    reviews: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The tables without the given rows (column id each) and all that hangs on them."""
    left = dict(tables)

    def without(name: str, column: str, ids: DataFrame) -> None:
        gone = ids.select(F.col("id").alias(column)).distinct()
        left[name] = left[name].join(gone, column, "left_anti").select(*left[name].columns)

    gone_repositories, gone_reviews = repositories, reviews
    if users is not None:
        without("users", "id", users)
        without("user_settings", "user_id", users)
        theirs = tables["repositories"].join(
            users.select(F.col("id").alias("user_id")).distinct(), "user_id", "left_semi"
        ).select("id")
        gone_repositories = theirs if repositories is None else theirs.union(repositories.select("id"))
        own = tables["reviews"].join(
            users.select(F.col("id").alias("user_id")).distinct(), "user_id", "left_semi"
        ).select("id")
        gone_reviews = own if reviews is None else own.union(reviews.select("id"))
    if gone_repositories is not None:
        without("repositories", "id", gone_repositories)
        inside = tables["reviews"].join(
            gone_repositories.select(F.col("id").alias("repository_id")).distinct(),
            "repository_id",
            "left_semi",
        ).select("id")
        gone_reviews = inside if gone_reviews is None else inside.union(gone_reviews.select("id"))
    if gone_reviews is not None:
        without("reviews", "id", gone_reviews)
        ids = gone_reviews.select(F.col("id").alias("review_id"))
        for name in ("review_issues", "file_analysis_results"):
            left[name] = rows_not_of(left[name], ids).select(*left[name].columns)
    return left


# ---- audits -----------------------------------------------------------------

UNIQUE_KEYS = [
    ("users", "id"),
    ("users", "email"),
    ("users", "github_id"),
    ("repositories", "id"),
    ("reviews", "id"),
    ("user_settings", "user_id"),
    ("user_settings", "id"),
    ("review_issues", "id"),
    ("file_analysis_results", "id"),
]
FOREIGN_KEYS = [
    ("repositories", "user_id", "users"),
    ("reviews", "user_id", "users"),
    ("reviews", "repository_id", "repositories"),
    ("user_settings", "user_id", "users"),
    ("review_issues", "review_id", "reviews"),
    ("file_analysis_results", "review_id", "reviews"),
]


def _violation(table: str, kind: str, column: str, value: Column, n: Column) -> list[Column]:
    return [
        F.lit(table).alias("table_name"),
        F.lit(kind).alias("kind"),
        F.lit(column).alias("column_name"),
        value.cast("string").alias("value"),
        n.cast("long").alias("n_rows"),
    ]


def _union(parts: list[DataFrame]) -> DataFrame:
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def audit_unique(tables: dict[str, DataFrame]) -> DataFrame:
    """Values that occur more than once where they must not."""
    parts = []
    for table, column in UNIQUE_KEYS:
        if table in tables and column in tables[table].columns:
            counts = tables[table].where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
            parts.append(
                counts.where(F.col("_n") > 1).select(
                    *_violation(table, "not_unique", column, F.col(column), F.col("_n"))
                )
            )
    return _union(parts)


def audit_orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """References to rows that do not exist.

    Children are counted per reference before the join, so the join sees each
    reference once however many rows carry it.
    """
    parts = []
    for table, column, parent in FOREIGN_KEYS:
        if table in tables and parent in tables:
            counts = tables[table].where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
            ids = tables[parent].select(F.col("id").alias(column)).distinct()
            parts.append(
                counts.join(ids, column, "left_anti").select(
                    *_violation(table, "orphan", column, F.col(column), F.col("_n"))
                )
            )
    return _union(parts)


def audit_domains(tables: dict[str, DataFrame]) -> DataFrame:
    """Nulls, overlong texts, unknown values and confidences outside 0..1.

    All checks of a table are flags of one aggregation: one scan, one row out.
    """
    parts = []
    for table, df in tables.items():
        checks: list[tuple[str, str, Column]] = []
        for field in TABLES[table].fields:
            if field.name in df.columns and not field.nullable:
                checks.append(("null", field.name, F.col(field.name).isNull()))
        for column, limit in MAX_LENGTHS.get(table, {}).items():
            if column in df.columns:
                checks.append(("too_long", column, F.length(column) > limit))
        for column, values in VALUE_DOMAINS.get(table, {}).items():
            if column in df.columns:
                checks.append(("unknown_value", column, ~F.col(column).isin(values)))
        if table == "review_issues" and "confidence" in df.columns:
            out = ~F.col("confidence").between(0.0, 1.0)
            checks.append(("out_of_range", "confidence", out))
        counted = df.agg(*[F.count_if(c).alias(f"_{i}") for i, (_, _, c) in enumerate(checks)])
        rows = [
            F.struct(
                F.lit(table).alias("table_name"),
                F.lit(kind).alias("kind"),
                F.lit(column).alias("column_name"),
                F.col(f"_{i}").alias("n_rows"),
            )
            for i, (kind, column, _) in enumerate(checks)
        ]
        parts.append(
            counted.select(F.explode(F.array(*rows)).alias("_v")).select("_v.*").where(F.col("n_rows") > 0)
        )
    return _union(parts)


def quarantine_issues(issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split issues into those with a confidence in 0..1 and the others."""
    fine = F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False))
    return issues.where(fine), issues.where(~fine)
