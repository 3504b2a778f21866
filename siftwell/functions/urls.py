"""URL validation and normalisation as one expression: no UDF, so filters on the result stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

#: What a user reads for each error.
MESSAGES = {
    "empty": "Please enter a website URL before clicking Audit.",
    "too_short": "'{}' does not look like a valid website address.",
    "bare_scheme": "The scheme '{}:' is not supported. Please enter an http:// or https:// website address.",
    "scheme": "The scheme '{}://' is not supported. Please enter an http:// or https:// website address.",
    "no_domain": "The URL does not contain a valid domain name. Please check and try again.",
    "no_dot": "'{}' does not look like a valid domain name. Please include the full domain, e.g. www.example.com.",
    "empty_label": "'{}' contains consecutive dots, which is not a valid domain name.",
    "long_label": "'{}' contains a segment longer than 63 characters, which is not valid.",
    "characters": "'{}' contains invalid characters. Please enter a standard web address.",
}
ALLOWED_SCHEMES = ("http", "https")
#: Scheme (which may be missing), authority, path with parameters, and query of generic URL syntax.
_WHOLE = r"(?s)\A(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?\z"
#: URLs that are normal as they stand, but for a fragment, most of all; what it leaves out may be normal too.
_NORMAL = r"\Ahttps?://(?!-)[a-z0-9\-]{1,63}(?:\.[a-z0-9\-]{1,63})+(?<!-)(?::[0-9]+)?(?:/[!\"$->@-~]+)?(?:\?[!\"$-~]+)?\z"
_SCHEME = r"(?s)\A([A-Za-z][A-Za-z0-9+.\-]*):(.*)\z"


def _say(key: str, what: Column | None = None) -> Column:
    before, _, after = MESSAGES[key].partition("{}")
    return F.lit(before) if what is None else F.concat(F.lit(before), what, F.lit(after))


def _failure(code: str, message: Column) -> Column:
    return _result(F.lit(False), F.lit(""), F.lit(code), message)


def _result(valid: Column, url: Column, code: Column, message: Column) -> Column:
    return F.struct(valid.alias("is_valid"), url.alias("normalized_url"), code.alias("error_code"), message.alias("error_message"))


def split_url(url: Column) -> dict[str, Column]:
    """Scheme (lower case), authority, path with parameters, query and fragment, as generic URL syntax has them."""
    clean = F.regexp_replace(F.regexp_replace(url, r"\A[\x00-\x20]+", ""), r"[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(clean, _SCHEME, 1))
    rest = F.when(clean.rlike(_SCHEME), F.regexp_extract(clean, _SCHEME, 2)).otherwise(clean)
    parts = r"(?s)\A(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
    return {"scheme": scheme} | {name: F.regexp_extract(rest, parts, i) for i, name in enumerate(("netloc", "path", "query", "fragment"), 1)}


def normalize_url(raw: Column) -> Column:
    """``struct<is_valid, normalized_url, error_code, error_message>``; the first rule that fails decides.  Null counts as empty."""

    def checked(u: Column) -> Column:
        url, token, netloc, host = u["url"], u["token"], u["netloc"], u["host"]
        bare = url.contains(":") & ~url.contains("://") & ~token.contains(".") & ~token.isin(*ALLOWED_SCHEMES)
        bad = F.get(F.filter(F.split(host, r"\."), lambda x: (x == "") | (F.char_length(x) > 63)), F.lit(0))
        path = F.when(u["path"] == "/", F.lit("")).otherwise(u["path"])
        query = F.when(u["query"] != "", F.concat(F.lit("?"), u["query"])).otherwise(F.lit(""))
        return (
            F.when(url == "", _failure("empty", _say("empty")))
            .when(F.char_length(url) < 4, _failure("too_short", _say("too_short", url)))
            .when(bare, _failure("scheme_not_allowed", _say("bare_scheme", token)))
            .when(~u["scheme"].isin(*ALLOWED_SCHEMES), _failure("scheme_not_allowed", _say("scheme", u["scheme"])))
            .when(netloc == "", _failure("no_domain", _say("no_domain")))
            .when(~host.contains("."), _failure("invalid_domain", _say("no_dot", host)))
            .when(bad == "", _failure("invalid_domain", _say("empty_label", host)))
            .when(bad.isNotNull(), _failure("invalid_domain", _say("long_label", host)))
            .when(~host.rlike(r"\A[a-z0-9][a-z0-9\-.]*[a-z0-9](:\d+)?\z"), _failure("invalid_domain", _say("characters", host)))
            .otherwise(_result(F.lit(True), F.concat(u["scheme"], F.lit("://"), netloc, path, query), F.lit(""), F.lit("")))
        )

    def split(url: Column) -> Column:
        clean = F.regexp_replace(F.regexp_replace(F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url)), r"\A[\x00-\x20]+", ""), r"[\t\r\n]", "")
        return let(F.struct(url.alias("url"), *[F.regexp_extract(clean, _WHOLE, k).alias(n) for k, n in enumerate(("scheme", "netloc", "path", "query"), 1)]), named)

    def named(x: Column) -> Column:
        netloc = F.lower(x["netloc"])
        return let(F.struct(x["url"], F.lower(F.substring_index(x["url"], ":", 1)).alias("token"), F.lower(x["scheme"]).alias("scheme"), netloc.alias("netloc"), F.substring_index(netloc, ":", 1).alias("host"), x["path"], x["query"]), checked)

    return let(strip(F.coalesce(raw, F.lit(""))), split)


def normal_url(url: Column) -> Column:
    """The one form of a URL that links and captures are compared in; null where it is none."""

    def normal(u: Column) -> Column:
        bare = F.substring_index(u, "#", 1)
        return F.when(bare.rlike(_NORMAL), bare).otherwise(let(normalize_url(u), lambda n: F.when(n["is_valid"], n["normalized_url"])))

    return let(url, normal)


def site_root(url: Column) -> Column:
    """Scheme and authority of an absolute URL."""
    return F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
