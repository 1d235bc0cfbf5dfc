"""URL filter with redirect equivalence (operator 2).

Pages that name each other by a canonical link or an immediate refresh are one resource. Components of those edges carry the
decisions of the rules to pages that no rule names. Order of precedence: the page's own longest rule; an allow rule of any
page of its component; a block rule of any page of its component; allow.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import small_batches, table, texts_of, written
from factorspark.llm.graph import components
from factorspark.llm.html_crf import NO_MARKUP, start_tags


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

_NAMING = frozenset(("link", "meta", "base"))
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_URL_IN_REFRESH = re.compile(r"""^[\s\d.]*[;,\s]\s*(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|(.*))""", re.I | re.S)
# RFC 3986, appendix B.
_REFERENCE = re.compile(r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?", re.S)
_BLANK = " \t\n\f\r"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column, group: str) -> Column:
    """A group of what follows the first `://`; empty for null or without `://`."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://" + group, 1), F.lit(""))


def host_of(url: Column) -> Column:
    """Lower-case host; empty for null or without `://`."""
    return F.translate(_after_scheme(url, "([^/?#]*)"), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return _after_scheme(url, "[^/?#]*([^?#]*)")


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Index of the fitting rule with the longest text, of equally long ones the first; null if none fits."""
    out = F.lit(None).cast("int")
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].host + rules[i].path), i))
    for i in reversed(order):
        r = rules[i]
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(i)).otherwise(out)
    return out


def node_of(url: Column) -> Column:
    """What names a resource in an edge: host, path and query, without scheme and fragment. Null without a host."""
    return F.when(host_of(url) != "", F.concat(host_of(url), _after_scheme(url, "[^/?#]*([^#]*)")))


def without_dots(path: str) -> str:
    """Dot segments removed (RFC 3986, 5.2.4)."""
    out: list[str] = []
    parts = path.split("/")
    for i, part in enumerate(parts):
        if part in (".", ".."):
            if part == ".." and len(out) > 1:
                out.pop()
            if i == len(parts) - 1:
                out.append("")
        else:
            out.append(part)
    return "/".join(out)


def resolved(base: str, reference: str) -> str | None:
    """The absolute form of `reference` on `base` (RFC 3986, 5.2.2), without fragment; None if it names no host."""
    scheme, host, path, query = _REFERENCE.match(reference).groups()
    if scheme is None:
        scheme, base_host, base_path, base_query = _REFERENCE.match(base).groups()
        if host is None:
            host = base_host
            if not path:
                path, query = base_path, base_query if query is None else query
            elif not path.startswith("/"):
                path = (base_path[: base_path.rfind("/") + 1] or "/") + path
    if scheme is None or not host:
        return None
    return f"{scheme}://{host}{without_dots(path)}{query or ''}"


def targets_of(url: str, html_text: str) -> list[str]:
    """What the page's canonical links and refreshes name, all of them, against the page's `base` if it has one. Comments, scripts,
    templates and the attributes of other tags name nothing."""
    base, found = None, []
    for tag, inside in start_tags(html_text, _NAMING):
        given: dict[str, str] = {}
        for name, *values in _ATTRIBUTE.findall(inside):
            given.setdefault(name.lower(), html.unescape("".join(values)))
        if tag == "base" and base is None and "href" in given:
            base = resolved(url, given["href"].strip(_BLANK))
        if tag == "link" and "canonical" in given.get("rel", "").lower().split():
            found.append(given.get("href", "").strip(_BLANK))
        if tag == "meta" and given.get("http-equiv", "").strip(_BLANK).lower() == "refresh":
            m = _URL_IN_REFRESH.match(given.get("content", ""))
            found.append(next((x for x in m.groups() if x), "").strip(_BLANK) if m else "")
    return [t for reference in found if reference and (t := resolved(base or url, reference))]


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): resources that a page's canonical links and refreshes say are the same. A url with dot segments is the same as without."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, targets = [], []
            for url, text in zip(batch.column("url").to_pylist(), texts_of(batch, "html")):
                named = targets_of(url, text)
                if without_dots(_REFERENCE.match(url)[3]) != _REFERENCE.match(url)[3] and (own := resolved("", url)):
                    named.append(own)
                urls += [url] * len(named)
                targets += named
            yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(targets, pa.string())], names=["url", "target"])

    some = F.lower("html").rlike("canonical|http-equiv") | F.col("url").rlike(r"/\.\.?([/?#]|$)")
    found = written(pages.where(some & F.col("url").isNotNull()).select("url", "html").mapInArrow(run, "url string, target string"), "hrefs")
    ends = found.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b"))
    return ends.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    Null urls and urls without `://` have empty host and path, fit no rule and are allowed. Null html names no other page.
    Repeated pages are judged each; of rules of equal length the first given wins.
    """
    url = F.col("url")
    judged = pages.select(
        "page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"),
        longest_rule(host_of(url), path_of(url), rules).alias("r"),
    )
    texts = F.array(*[F.lit(r.host + r.path) for r in rules]) if rules else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(r.verdict) for r in rules]) if rules else F.array().cast("array<string>")
    judged = judged.withColumns({"rule": F.get(texts, F.col("r")), "own": F.get(verdicts, F.col("r"))})
    parts = written(components(alias_edges(pages)), "aliases")
    # Only pages on an edge meet their component; all pages of one resource are first made one row.
    known = judged.where("own IS NOT NULL AND node IS NOT NULL").groupBy("node").agg(
        F.max(F.col("own") == "allow").alias("allowed")
    )
    decided = parts.join(known, "node").groupBy("component").agg(F.max("allowed").alias("allowed"))
    by_node = parts.join(decided, "component").select("node", "allowed")
    return judged.join(by_node, "node", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce(F.col("own"), F.when(~F.col("allowed"), "block").otherwise("allow")).alias("verdict"),
    )


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    """The verdict on every url of `pages`."""
    return judge_urls(table(spark, sf_dir, "pages"))


def _sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB, but for dot segments, `base` and character references other than `&amp;`; components by a recursive set of
    reachable nodes, which suits small tables only."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].host + rules[i].path), i))
    fits = [
        f"WHEN (host = '{rules[i].host}' OR ends_with(host, '.{rules[i].host}')) AND starts_with(path, '{rules[i].path}')"
        for i in order
    ]
    rule = "CASE " + " ".join(f"{f} THEN '{rules[i].host}{rules[i].path}'" for f, i in zip(fits, order)) + " END"
    own = "CASE " + " ".join(f"{f} THEN '{rules[i].verdict}'" for f, i in zip(fits, order)) + " END"
    rest = "CASE WHEN strpos({u}, '://') > 0 THEN substr({u}, strpos({u}, '://') + 3) END"
    host = f"coalesce(translate(regexp_extract({rest}, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}'), '')"
    node = f"CASE WHEN {host} <> '' THEN {host} || regexp_extract({rest}, '^[^/?#]*([^#]*)', 1) END"
    target = (
        "CASE WHEN contains(href, '://') THEN href"
        " WHEN starts_with(href, '//') THEN regexp_extract(url, '^[^:/?#]*', 0) || ':' || href"
        " WHEN starts_with(href, '/') THEN regexp_extract(url, '^[^:/?#]*', 0) || '://' || "
        + host.format(u="url") + " || href"
        " WHEN starts_with(href, '?') THEN regexp_extract(url, '^[^?#]*', 0) || href"
        " WHEN href <> '' AND NOT starts_with(href, '#') AND NOT regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN"
        " regexp_extract(url, '^[^:/?#]*', 0) || '://' || " + host.format(u="url") + " || coalesce(nullif(regexp_extract("
        + rest.format(u="url") + ", '^[^/?#]*([^?#]*/)', 1), ''), '/') || href END"
    )
    hidden = "|".join(["<!--.*?(?:-->|$)", *(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in sorted(NO_MARKUP)), r"<script\b[^>]*>.*$"])
    clean = f"regexp_replace(html, '{hidden}', '', 'gis')"
    tag = {"canonical": r"<link\b[^>]*\brel\s*=\s*(?:[\"''][^\"''>]*)?\bcanonical\b[^>]*>", "refresh": r"<meta\b[^>]*\bhttp-equiv\s*=\s*[\"'']?refresh\b[^>]*>"}
    value = {"canonical": r"\bhref\s*=\s*[\"'']?([^\"''\s>]+)", "refresh": r"\burl\s*=\s*[\"'']?([^\"''\s>]+)"}
    hrefs = " UNION ALL ".join(
        f"SELECT url, replace(regexp_extract(unnest(regexp_extract_all({clean}, '{tag[k]}', 0, 'is')), '{value[k]}', 1, 'is'), '&amp;', '&') AS href FROM pages"
        for k in tag
    )
    return f"""
WITH RECURSIVE parsed AS (
  SELECT page_id, {host.format(u='url')} AS host,
         coalesce(regexp_extract({rest.format(u='url')}, '^[^/?#]*([^?#]*)', 1), '') AS path, {node.format(u='url')} AS node
  FROM pages),
judged AS (SELECT *, {rule} AS rule, {own} AS own FROM parsed),
hrefs AS ({hrefs}),
targets AS (SELECT url, {target} AS target FROM hrefs),
edges AS (SELECT {node.format(u='url')} AS a, {node.format(u='target')} AS b FROM targets),
both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(node, other) AS (
  SELECT a, a FROM both_ways
  UNION
  SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
decided AS (
  SELECT reach.node, bool_or(own = 'allow') AS allowed
  FROM reach JOIN judged ON judged.node = reach.other WHERE own IS NOT NULL GROUP BY reach.node)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN NOT allowed THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN decided USING (node)"""


SQL = _sql()
