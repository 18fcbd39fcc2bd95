"""Scalar functions over columns: domains, urls, labels, JSON and numbers (FN-1 to FN-31)."""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Unicode text splitting knows it, for a Java character class.
WHITE = r"\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# The platform's host suffix.
PLATFORM = ".substack.com"


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_domain(url: str | Column) -> Column:
    """FN-1: host part, lower-cased, up to the first slash, then colon; a platform host becomes its first label."""
    bare = F.replace(F.replace(_col(url), F.lit("https://")), F.lit("http://"))
    host = F.lower(F.substring_index(F.substring_index(bare, "/", 1), ":", 1))
    return F.when(host.endswith(PLATFORM), F.substring_index(host, ".", 1)).otherwise(host)


def publication_url(domain: str | Column) -> Column:
    """FN-2: a custom domain stands for itself, anything else is a label on the platform."""
    d = _col(domain)
    custom = d.contains(".") & ~d.contains(PLATFORM[1:])
    return F.when(custom, F.concat(F.lit("https://"), d)).otherwise(F.concat(F.lit("https://"), F.replace(d, F.lit(PLATFORM)), F.lit(PLATFORM)))


def archive_url(domain: str | Column) -> Column:
    """FN-3."""
    return F.concat(publication_url(domain), F.lit("/archive"))


def base_url(url: str | Column) -> Column:
    """FN-4: ``https://host`` of any url; https is the default scheme, null for an empty url."""
    u = F.rtrim(F.trim(_col(url)), F.lit("/"))
    host = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]+)", 1)
    return F.when(host != "", F.concat(F.lit("https://"), host))


def scheme_and_host(url: str | Column) -> Column:
    """FN-5: scheme and host of a url; null where it is no valid url."""
    u = F.trim(_col(url))
    return F.concat(F.try_parse_url(u, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(u, F.lit("AUTHORITY")))


def host(url: str | Column) -> Column:
    """FN-6: host with port, lower-cased; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(_col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def normalize_handle(value: str | Column) -> Column:
    """FN-7: the handle of a name or profile url, lower-cased; null where none is left."""
    v = F.trim(_col(value))
    no_scheme = F.regexp_replace(v, r"^(?i)https?://", "")
    is_url = v.rlike(r"^(?i)https?://")
    host_part, path = F.substring_index(no_scheme, "/", 1), F.regexp_extract(no_scheme, r"^[^/]*/+([^/]*)", 1)
    platform = F.lower(host_part).endswith(PLATFORM) & ~F.lower(host_part).isin("www" + PLATFORM)
    from_url = F.when(path != "", path).when(platform, F.substring_index(host_part, ".", 1)).otherwise(F.lit(""))
    raw = F.when(is_url, from_url).otherwise(v)
    bare = F.regexp_replace(F.regexp_replace(raw, r"^@+", ""), r"[?#].*$", "")
    bare = F.trim(bare, F.lit("/"))
    return F.when(bare.rlike(r"^[A-Za-z0-9_.-]+\z"), F.lower(bare))


def display_name(name: str | Column, domain: str | Column) -> Column:
    """FN-8: the trimmed name, else the domain."""
    trimmed = F.regexp_replace(_col(name), rf"^[{WHITE}]+|[{WHITE}]+\z", "")
    return F.coalesce(F.nullif(trimmed, F.lit("")), _col(domain))


def shortened(value: str | Column, limit: int, keep: int) -> Column:
    v = _col(value)
    return F.when(F.length(v) > limit, F.concat(F.substring(v, 1, keep), F.lit(".."))).otherwise(v)


def graph_label(domain: str | Column) -> Column:
    """FN-9: without ``www.`` and leading dots, at most 27 characters."""
    d = _col(domain)
    bare = F.ltrim(F.when(d.startswith("www."), F.substring(d, 5, 1 << 30)).otherwise(d), F.lit("."))
    return shortened(bare, 27, 25)


def console_name(name: str | Column) -> Column:
    """FN-10."""
    return shortened(name, 29, 27)


def console_domain(domain: str | Column) -> Column:
    """FN-10."""
    return shortened(domain, 34, 32)


def console_depth(depth: str | Column) -> Column:
    """FN-10: a dash for an unknown depth."""
    return F.coalesce(_col(depth).cast("string"), F.lit("—"))


def scaled_size(value: str | Column, least: str | Column, most: str | Column) -> Column:
    """FN-11: 8 to 35, linear between the least and the most; 8 if these are equal."""
    span = F.when(_col(most) > _col(least), _col(most) - _col(least)).otherwise(F.lit(1.0))
    return 8 + 27 * (_col(value) - _col(least)) / span


def collapsed(text: str | Column) -> Column:
    """FN-12: runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(_col(text), f"[{WHITE}]+", " "))


def content_hash(text: str | Column) -> Column:
    """FN-13."""
    return F.sha2(_col(text), 256)


def source_text(kind: str) -> Column:
    """FN-14: the text that is embedded for a row of ``comments``, ``posts`` or ``publications``."""
    if kind == "comments":
        return F.coalesce(F.col("body"), F.lit(""))
    columns = {"posts": ("title", "url"), "publications": ("name", "domain", "description")}[kind]
    return F.trim(F.array_join(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in columns]), " "))


def first_truthy(*values: Column) -> Column:
    """FN-15: the first string that is neither null nor empty nor, as JSON shows them, ``0`` or ``false``."""
    return F.coalesce(*[F.when(~v.isin("", "0", "0.0", "false"), v) for v in values])


def string_or_none(value: str | Column) -> Column:
    """FN-16: any value as text; null stays null."""
    return _col(value).cast("string")


def iso_now() -> str:
    """FN-29: the time of a run with its zone, read once on the driver and handed to the operators as ``at``."""
    return datetime.now(UTC).isoformat()


def first_list(payload: str | Column, *keys: str) -> Column:
    """FN-17: a JSON payload that is a list, or its first key that holds one, as an array of variants."""
    v = F.try_parse_json(_col(payload))
    tries = [F.try_variant_get(v, "$", "array<variant>")] + [F.try_variant_get(v, f"$.{k}", "array<variant>") for k in keys]
    return F.coalesce(*tries)


def canonical_json(value: str | Column) -> Column:
    """FN-18: JSON text with sorted keys and no blanks; null where it is not JSON."""
    return F.to_json(F.try_parse_json(_col(value)))


def body_text(body: Column, body_text_field: Column, text: Column) -> Column:
    """FN-19: the first of three fields that is there; an object gives its ``text`` or its JSON; never null."""
    first = F.coalesce(body, body_text_field, text)
    inner = F.get_json_object(first, "$.text")
    shown = F.when(first.startswith("{"), F.coalesce(inner, canonical_json(first), first)).otherwise(first)
    return F.coalesce(shown, F.lit(""))


SECRET = re.compile("token|secret|auth", re.IGNORECASE)


def _redact(value):
    if isinstance(value, dict):
        return {k: "[REDACTED]" if SECRET.search(str(k)) else _redact(v) for k, v in value.items()}
    return [_redact(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(StringType())
def redacted(payload: pd.Series) -> pd.Series:
    """FN-20: JSON text with the values of secret-looking keys blotted out at any depth; null if it is not JSON."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(_redact(json.loads(text)), ensure_ascii=False)
        except ValueError:
            return None

    return payload.map(one)


def ui_guess(is_personal: str | Column, forced_person: bool = False) -> Column:
    """FN-21."""
    if forced_person:
        return F.lit("person")
    p = _col(is_personal)
    return F.when(p, "person").when(~p, "publication").otherwise(F.lit("unknown"))


def recommendation_url(custom_domain: str | Column, subdomain: str | Column) -> Column:
    """FN-22: from a custom domain, else from a label on the platform; null without both."""
    c, s = F.nullif(_col(custom_domain), F.lit("")), F.nullif(_col(subdomain), F.lit(""))
    own = F.when(c.startswith("http"), c).otherwise(F.concat(F.lit("https://"), c))
    return F.coalesce(F.when(c.isNotNull(), own), F.concat(F.lit("https://"), s, F.lit(PLATFORM)))


def joined_errors(*errors: str | Column) -> Column:
    """FN-24: the errors that are there, parted by bars, else a dash."""
    found = F.filter(F.array(*[F.coalesce(_col(e), F.lit("")) for e in errors]), lambda x: x != "")
    return F.when(F.size(found) > 0, F.array_join(found, " | ")).otherwise(F.lit("—"))


def snapped_topic(topic: str | Column, labels: list[str], exact_first: bool = False) -> Column:
    """FN-26: the first label that contains the topic or is contained in it; the last for an empty topic."""
    t = F.lower(F.trim(_col(topic)))
    found = F.lit(None).cast("string")
    for label in reversed(labels):
        low = label.lower()
        found = F.when(F.lit(low).contains(t) | t.contains(low), label).otherwise(found)
    if exact_first:
        found = F.coalesce(*[F.when(t == label.lower(), label) for label in labels], found)
    return F.when(F.coalesce(t, F.lit("")) == "", labels[-1]).otherwise(F.coalesce(found, F.trim(_col(topic))))


def html_escaped(text: str | Column) -> Column:
    """FN-27."""
    out = _col(text)
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


def signed_thousands(value: str | Column) -> Column:
    """FN-28."""
    return F.format_string("%+,d", _col(value).cast("long"))


def vector_json(vector: str | Column) -> Column:
    """FN-30."""
    return F.to_json(_col(vector))


def topic_prompt(name: str = "name", domain: str = "domain", description: str = "description") -> Column:
    """FN-31: one line for each field; the description only if there is one."""
    lines = [F.concat(F.lit("Name: "), F.coalesce(F.col(name), F.lit(""))), F.concat(F.lit("Domain: "), F.col(domain)), F.concat(F.lit("Description: "), F.nullif(F.trim(F.col(description)), F.lit("")))]
    return F.concat_ws("\n", *lines)
