"""URL filter: a trie over reversed host labels and path segments; the longest rule that fits decides.

Rules are a short, hand-kept list whose size is checked before the trie is broadcast. A node of the trie is a host
label (from the last one up) or, below a host, a path segment; a rule's last segment may be the beginning of the
url's. The deepest host that has a fitting rule comes first, then the longest path; an allow and a block rule for
the same host and path: block.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

MOST_RULES = 100_000  # beyond that the trie (about 1 kB a rule) should not be broadcast


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased and path; both empty without `://`."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for mark in "?#":
        rest = rest.split(mark, 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


_LOWER = {c: c + 32 for c in range(65, 91)}


class Trie:
    """Nested dicts: host labels, then "/" to a list of path rules by their segments."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict {verdict!r}")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault(label, {})
            *inner, last = path.split("/")
            node = node.setdefault("/", {"end": {}})
            for segment in inner:
                node = node.setdefault(("segment", segment), {"end": {}})
            old = node["end"].get(last)
            if old is None or verdict == "block":
                node["end"][last] = (f"{host}{path}", verdict)
                node["lengths"] = sorted({len(x) for x in node["end"]}, reverse=True)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """Rule and verdict of the longest rule that fits."""
        node, found = self.root, None
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if "/" in node:
                found = self._path(node["/"], path) or found
        return found

    @staticmethod
    def _path(node: dict, path: str) -> tuple[str, str] | None:
        found = None
        for segment in path.split("/"):
            ends = node["end"]
            if ends:
                for n in node["lengths"]:  # of the rules' last segments, not of the url's
                    if n <= len(segment) and segment[:n] in ends:
                        found = ends[segment[:n]]
                        break
            node = node.get(("segment", segment))
            if node is None:
                break
        return found


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]], otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages.

    rules: (allow or block, host, path), the path with its slash. A rule fits its host and all subdomains where the
    url's path starts with the rule's. Without a fitting rule: rule null, verdict `otherwise`. Null urls and urls
    without `://` have an empty host and path, so only `otherwise` applies. Repeated rows are judged each; an empty
    table gives an empty result; other columns are ignored.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; up to {MOST_RULES} are broadcast")
    shared = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def judge(batches):
        trie = shared.value
        for batch in batches:
            rows = []
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                rule = trie.match(host, path) if host else None
                rows.append((host, path, *(rule or (None, otherwise))))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, pa.string()) for c in cols)], ["page_id", "host", "path", "rule", "verdict"])

    return pages.selectExpr("cast(page_id as bigint) AS page_id", "cast(url as string) AS url").mapInArrow(
        judge, "page_id long, host string, path string, rule string, verdict string"
    )
