"""Scalar functions over URLs, names and source text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_url(url: Column) -> Column:
    """Path with one leading slash, no doubled and no trailing slash; an empty path is `/`."""
    squeezed = F.regexp_replace(F.concat(F.lit("/"), F.coalesce(url, F.lit(""))), "/+", "/")
    return F.when(F.length(squeezed) > 1, F.regexp_replace(squeezed, "/$", "")).otherwise(squeezed)


def url_path(url: Column) -> Column:
    """Path of an absolute URL: without scheme, host, query and fragment."""
    return clean_url(F.regexp_replace(F.regexp_replace(url, "^[a-z]+://[^/?#]*", ""), "[?#].*$", ""))


def endpoint_id(service: Column, url: Column, method: Column, compat: bool = False) -> Column:
    """First 32 hex digits of SHA-256 over normalised service, path and method.

    Placeholders `{?}` become `{}` before the query is cut off; with compat=True the query is cut first, so that two
    templates that share what stands before their first placeholder share an id.
    """
    name = F.regexp_replace(F.regexp_replace(F.lower(service), "[-_]", ""), "^(ts|ms|svc)", "")
    path = url if compat else F.regexp_replace(url, r"\{\?\}", "{}")
    return F.substring(F.sha2(F.concat_ws(":", name, url_path(path), F.upper(method)), 256), 1, 32)


def templated(path: Column) -> Column:
    """Path segments that look like ids replaced by {id}: a UUID, a number, 24 hex digits, or 8 letters and digits or more, with dashes after them."""
    ids = r"^([0-9]+|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|[a-zA-Z0-9]{8,}(-[a-zA-Z0-9]+)*)$"
    return F.array_join(F.transform(F.split(path, "/"), lambda s: F.when(s.rlike(ids), "{id}").otherwise(s)), "/")


# Words that make an endpoint sensitive, in order of precedence; `transaction` counts for endpoint ids only.
SENSITIVE = {"FINANCIAL": "pay|refund|payment", "PII": "user|profile|personal|account", "INTERNAL": "admin|config|manage|report"}


def sensitivity(text: Column, transactions: bool = True) -> Column:
    """FINANCIAL, PII, INTERNAL or PUBLIC by the first list of words that occurs."""
    low = F.lower(text)
    money = SENSITIVE["FINANCIAL"] + ("|transaction" if transactions else "")
    return F.when(low.rlike(money), "FINANCIAL").when(low.rlike(SENSITIVE["PII"]), "PII").when(low.rlike(SENSITIVE["INTERNAL"]), "INTERNAL").otherwise("PUBLIC")


# By..And.., By..In and the two beginnings of names.
def injectable(name: Column) -> Column:
    """Repository method names whose derived query takes several conditions, a list, or deletes by another column than the id."""
    removes = F.lower(name).rlike("^(deleteby|remove)") & (F.lower(name) != "deletebyid")
    return name.rlike("By[A-Z].*And[A-Z]") | name.rlike("By[A-Z].*In$") | removes


def ant_regex(pattern: Column) -> Column:
    """Regular expression of an Ant path pattern; `/x/**` also matches `/x`."""
    p = F.regexp_replace(pattern, r"([.+^$()|\[\]\\])", r"\\$1")
    p = F.regexp_replace(p, r"\{[^}/]*\}", "[^/]+")
    p = F.regexp_replace(p, r"/\*\*$", "<tail>")
    p = F.regexp_replace(p, r"\*\*", "<any>")
    p = F.regexp_replace(F.regexp_replace(p, r"\*", "[^/]*"), r"\?", "[^/]")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(p, "<tail>", "(/.*)?"), "<any>", ".*"), F.lit("$"))


def ant_specificity(pattern: Column) -> Column:
    """1000 for an exact path, 900 with variables, 800 with single wildcards, 700 and 10 for each segment (with the empty one before the first slash) before `**`."""
    p = F.when(F.length(pattern) > 1, F.regexp_replace(pattern, "/$", "")).otherwise(pattern)
    before = F.regexp_replace(F.regexp_replace(p, r"\*\*.*$", ""), "/+$", "")
    many = 700 + F.when(before == "", 0).otherwise(10 * F.size(F.split(before, "/")))
    exact = ~p.rlike(r"[*?{]")
    return F.when(p.isNull(), 0).when(exact, 1000).when(p.contains("{") & p.contains("}"), 900).when(p.contains("*") & ~p.contains("**"), 800).when(p.contains("?"), 800).when(p.contains("**"), many).otherwise(600)


# What adds a branch to a method's complexity.
BRANCHES = (r"\bif\b", r"\bfor\b", r"\bwhile\b", r"\bdo\b", r"\bcase\b", r"\bcatch\b", "&&", r"\|\|", r"\? :")


def cyclomatic(code: Column) -> Column:
    """1 and a branch for each keyword or short-circuit operator in a method body without comments and strings."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(code, r"(?m)//[^\n]*", " "), r"(?s)/\*.*?\*/", " "), r'"(\\.|[^"\\])*"', " ")
    return F.lit(1) + sum(F.regexp_count(bare, F.lit(p)) for p in BRANCHES)


# Default values that are no secrets.
NO_SECRETS = ("root", "admin", "password", "null", "false", "true")


def secrets(text: Column, key: Column | None = None) -> Column:
    """Hard-coded secrets of a configuration value: default values of ${NAME:default} placeholders, and, under a key that names a password, secret or key, what follows the last colon, without quotes and up to a `$`. Longer than 7 characters and none of the stop words."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\$\{[A-Z0-9_]+:([^}]+)\}"), 1), lambda v: F.trim(v))
    if key is not None:
        plain = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.element_at(F.split(text, ":"), -1)), "^['\"]+|['\"]+$", ""), r"(?s)\$.*$", ""))
        found = F.concat(found, F.when(F.lower(key).rlike("password|secret|key"), F.array(plain)).otherwise(F.array().cast("array<string>")))
    return F.filter(found, lambda v: (F.length(v) > 7) & ~F.lower(v).isin(*NO_SECRETS))


# What a query begins with, and the first word of a repository method's name, by kind of operation.
QUERY_KINDS = {"SELECT": "SELECT|FROM", "INSERT": "INSERT", "UPDATE": "UPDATE", "DELETE": "DELETE"}
METHOD_KINDS = {"SELECT": "find|get|read|query|search|count|exists", "INSERT": "save|insert|create", "UPDATE": "update|modify", "DELETE": "delete|remove"}


def operation_type(name: Column, query: Column | None = None) -> Column:
    """Database operation by the beginning of a query's text, where there is one, else of a repository method's name; UNKNOWN for others."""
    by_name = F.coalesce(*(F.when(name.rlike(f"^({words})"), kind) for kind, words in METHOD_KINDS.items()), F.lit("UNKNOWN"))
    if query is None:
        return by_name
    by_query = F.coalesce(*(F.when(F.upper(F.trim(query)).rlike(f"^({words})"), kind) for kind, words in QUERY_KINDS.items()), F.lit("UNKNOWN"))
    return F.when(query.isNotNull(), by_query).otherwise(by_name)


def band(score: Column) -> Column:
    """Colour band of a score between 0 and 1."""
    return F.when(score == 0, "none").when(score < 0.3, "low").when(score < 0.6, "medium").when(score < 0.8, "high").otherwise("critical")


def display_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "^(ts|ms|app)-", ""), "-(service|api)$", "")


# Resources of an API whose service is named for one of them.
RESOURCES = ("users", "orders", "routes", "travels", "stations", "prices", "contacts", "trains", "seats", "assurances", "foods", "consigns")


def kebab_case(name: Column) -> Column:
    """camelCase as camel-case."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1-$2"), "([A-Z])([A-Z][a-z])", "$1-$2"))


def service_of_url(url: Column) -> Column:
    """Service that an endpoint's URL names: `/api/v1/xService/..` or `/xService/..` mean ts-x-service, `/api/v1/orders/..` ts-order-service for the RESOURCES; else null."""
    named = [F.regexp_extract(url, p, 1) for p in (r"/api/v\d+/([a-zA-Z0-9]+)(?:service|Service)(?:/|$)", r"^/([a-zA-Z0-9]+)(?:service|Service)(?:/|$)")]
    resource = F.regexp_replace(F.regexp_extract(url, rf"/api/v\d+/({'|'.join(RESOURCES)})(?:/|$)", 1), "(?<=[^s])s$", "")
    part = F.coalesce(*(F.when(n != "", kebab_case(n)) for n in named), F.when(resource != "", resource))
    return F.concat(F.lit("ts-"), part, F.lit("-service"))


def flexible_name(name: str) -> str:
    """Regular expression for a name whose dashes, underscores and spaces may be any number of any of them."""
    import re

    return "[-_\\s]*".join(re.escape(part) for part in re.split(r"[-_\s]+", name))


def without_fence(text: Column) -> Column:
    """Text without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z0-9]*\s*", ""), r"\s*```$", "")


def github(url: Column) -> Column:
    """Owner and repository of a GitHub URL, `.git` left off; null where it is none."""
    pattern = r"github\.com[:/]([^/]+)/([^/?#]+?)(?:\.git)?/?(?:[?#].*)?$"
    owner, repo = (F.nullif(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return F.struct(owner.alias("owner"), repo.alias("repo"))


def subject(message: Column) -> Column:
    """First line of a commit message, 200 characters at most."""
    return F.substring(F.substring_index(message, "\n", 1), 1, 200)


def first_hop(forwarded: Column) -> Column:
    """First address of a forwarding header."""
    return F.trim(F.element_at(F.split(forwarded, ","), 1))


def public_address(ip: Column) -> Column:
    """Whether an IPv4 address is none of the private, loopback, link-local, shared or reserved ranges; false for what is no address."""
    part = lambda i: F.try_element_at(F.split(ip, r"\."), F.lit(i)).try_cast("int")
    a, b = part(1), part(2)
    valid = ip.rlike(r"^(\d{1,3}\.){3}\d{1,3}$") & F.forall(F.transform(F.split(ip, r"\."), lambda x: x.try_cast("int")), lambda x: x <= 255)
    inner = a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    return F.coalesce(valid & ~inner, F.lit(False))


def squeezed(text: Column) -> Column:
    """Text with all white space as single spaces."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def spel_roles(expression: Column) -> Column:
    """Roles that hasRole, hasAnyRole and hasAuthority expressions name, without ROLE_, sorted."""
    calls = F.regexp_extract_all(expression, F.lit(r"has(?:Any)?(?:Role|Authority)\(([^)]*)\)"), 1)
    names = F.flatten(F.transform(calls, lambda c: F.regexp_extract_all(c, F.lit("['\"]([^'\"]+)['\"]"), 1)))
    return F.array_sort(F.array_distinct(F.transform(names, lambda r: F.regexp_replace(r, "^ROLE_", ""))))


# Entities of repositories that aren't named for them, by a part of the repository's name and by all of it.
ENTITY_BY_PART = {"Money": "Money", "ConsignPrice": "ConsignPrice", "StationFood": "StationFoodStore"}
ENTITY_BY_NAME = {"Consign": "ConsignRecord", "Notify": "NotifyInfo", "OrderOther": "Order"}


def entity_of_repository(name: Column) -> Column:
    """Entity of a repository by its name: what stands before `Repository`, or that one's alias; the name itself where it has none."""
    name = F.trim(name)
    cut = F.regexp_extract(name, "(?i)^(.+?)Repository$", 1)
    aliases = [F.when(cut.contains(k), v) for k, v in ENTITY_BY_PART.items()] + [F.when(cut == k, v) for k, v in ENTITY_BY_NAME.items()]
    return F.when(cut == "", name).otherwise(F.coalesce(*aliases, cut))


def tokens_per_minute(n: Column) -> Column:
    """A number with K or M, as long as it is whole."""
    return F.when((n >= 1_000_000) & (n % 1_000_000 == 0), F.concat((n / 1_000_000).cast("long").cast("string"), F.lit("M"))).when((n >= 1000) & (n % 1000 == 0), F.concat((n / 1000).cast("long").cast("string"), F.lit("K"))).otherwise(n.cast("string"))
