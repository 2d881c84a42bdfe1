"""Repository references: URLs and ``owner/name`` short forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintmill.functions.text import let, strip

# ---- fixed values: hosts, name patterns, forbidden characters ---------------

HOST = "github.com"
HOSTS = ["github.com", "www.github.com"]
OWNER = r"^[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,37}[a-zA-Z0-9])?\z"
NAME = r"^[a-zA-Z0-9._-]+\z"
FORBIDDEN = "[\\n\\r\\x00;|&$`<>\"'\\\\]"


def _short_parts(text: Column) -> Column:
    """Parts of ``owner/name``; an empty one is kept, for the check to fail on."""
    return F.split(F.btrim(text, F.lit("/")), "/", -1)


def _url_parts(text: Column) -> Column:
    """Host, then the non-empty parts of the path; query and fragment are dropped."""
    with_scheme = F.when(text.rlike("^https?://"), text).otherwise(F.concat(F.lit("https://"), text))
    rest = F.regexp_replace(F.replace(with_scheme, F.lit("\t"), F.lit("")), r"(?s)^https?://|[?#].*\z", "")
    return let(
        F.split(rest, "/", -1),
        lambda p: F.concat(
            F.array(F.lower(F.get(p, F.lit(0)))), F.filter(F.slice(p, F.lit(2), F.size(p)), lambda x: x != "")
        ),
    )


def _judged(owner: Column, name: Column, error: Column) -> Column:
    error = error.when(~owner.rlike(OWNER), "invalid_owner").when(~name.rlike(NAME), "invalid_name")
    return F.struct(owner.alias("owner"), name.alias("name"), error.alias("error"))


def _from_parts(parts: Column, first: int, bad_host: Column) -> Column:
    owner, name = F.get(parts, F.lit(first)), F.get(parts, F.lit(first + 1))
    not_two = (F.size(parts) != first + 2) | (owner == "") | (name == "")
    error = F.when(bad_host, "unsupported_host").when(not_two, "not_owner_and_name")
    return _judged(owner, F.regexp_replace(name, r"\.git\z", ""), error)


def parse_repo_ref(source: Column) -> Column:
    """Struct of owner, name, error; error is null for a valid reference."""
    nothing = F.lit(None).cast("string")

    def failed(code: str) -> Column:
        return F.struct(nothing.alias("owner"), nothing.alias("name"), F.lit(code).alias("error"))

    def parsed(text: Column) -> Column:
        is_short = ~F.contains(F.lower(text), F.lit(HOST))
        short = let(_short_parts(text), lambda p: _from_parts(p, 0, F.lit(False)))
        url = let(_url_parts(text), lambda p: _from_parts(p, 1, ~F.get(p, F.lit(0)).isin(HOSTS)))
        return (
            F.when(text.isNull() | (text == ""), failed("empty"))
            .when(text.rlike(FORBIDDEN), failed("forbidden_character"))
            .when(is_short, short)
            .otherwise(url)
        )

    return let(
        let(strip(source), parsed),
        lambda r: F.struct(
            F.when(r["error"].isNull(), r["owner"]).alias("owner"),
            F.when(r["error"].isNull(), r["name"]).alias("name"),
            r["error"].alias("error"),
        ),
    )


def html_url(owner: Column, name: Column) -> Column:
    return F.concat(F.lit(f"https://{HOST}/"), owner, F.lit("/"), name)


def clone_url(owner: Column, name: Column) -> Column:
    return F.concat(html_url(owner, name), F.lit(".git"))
