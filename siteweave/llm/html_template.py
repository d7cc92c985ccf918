"""Main text of web pages by template deduction from equivalence classes of tokens."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import batches, prepare, texts
from .html_blocks import blocks, hashed

#: Share of a host's pages that a class of template tokens is on, and pages that a host has at least for texts to be template.
SUPPORT, LEAST_PAGES = 0.5, 4
#: Pages and tokens that a class has at least; each word of a text is a token here.
LEAST_ON, LEAST_TOKENS = 3, 3
#: Template tokens that are broadcast, at most (16 bytes each), and hosts that count as large (each has more than this share of all pages).
BROADCAST_TOKENS, LARGE_HOSTS = 500_000, 256


def host_of(url) -> object:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))


def token_sequence(html: str) -> list[tuple[int, int]]:
    """(token, size) in page order, outside elements left out: the role of each block, and its text in that role."""
    out = []
    for b in blocks(html):
        if not b.outside:
            out += [(b.path, 1), (text_token(b), len(b.text.split()))]
    return out


def text_token(b) -> int:
    return hashed(str(b.path), b.text)


def checked_classes(sequence: list[int], classes: dict[int, int]) -> list[tuple[int, int, bool]]:
    """(class, hash of its order, whether it holds) of each class on a page; classes has the class of each token.

    A class holds if its tokens come in one order, as often as they come, and if it nests: each of
    its spans lies in one gap of every larger class that holds, or the other way round.
    """
    size = Counter(classes.values())
    at: dict[int, list[int]] = {}
    for i, t in enumerate(sequence):
        if (c := classes.get(t)) is not None:
            at.setdefault(c, []).append(i)
    spans = lambda p, k: [(p[i], p[i + k - 1]) for i in range(0, len(p), k)]
    within = lambda p, k, q: all(bisect_left(q, x) == bisect_left(q, y) for x, y in spans(p, k))
    out, held = [], []
    for c in sorted(at, key=lambda c: (-size[c], c)):
        p, k = at[c], size[c]
        names = [sequence[i] for i in p]
        ok = len(p) % k == 0 and len(set(names[:k])) == k and all(x == names[i % k] for i, x in enumerate(names))
        ok = ok and all(within(p, k, q) or within(q, m, p) for q, m in held)
        if ok:
            held.append((p, k))
        out.append((c, hashed(*map(str, names[:k])), ok))
    return out


def with_host(rows: DataFrame, lists: DataFrame, sizes: DataFrame, what: str, how: str) -> DataFrame:
    """rows joined to the list that their host has in the column what; sizes has (host, pages).

    The lists go to where the rows lie if all of them together are small. If not, only those of the
    few hosts with a large share of all pages do, and the other rows are dealt by host.
    """
    total = lists.agg(F.sum(F.size(what))).first()[0] or 0
    if total <= BROADCAST_TOKENS:
        return rows.join(F.broadcast(lists), "host", how)
    least = (sizes.agg(F.sum("pages")).first()[0] or 0) // LARGE_HOSTS
    large = F.broadcast(sizes.where(F.col("pages") > least).select("host"))  # fewer than LARGE_HOSTS hosts
    here = rows.join(large, "host", "left_semi").join(F.broadcast(lists.join(large, "host", "left_semi")), "host", how)
    dealt = rows.join(large, "host", "left_anti").join(lists.join(large, "host", "left_anti").hint("merge"), "host", how)
    return here.select(*dealt.columns).union(dealt)


def template_tokens(pages: DataFrame, url: str, html: str, support: float = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """((host, tokens), (host, pages)): the constants of each host's template, as hashes of path and text, and the hosts' numbers of distinct pages.

    Every token of a page, an element's role or a text in its role, gets an occurrence vector over
    the host's pages: its fingerprint joins the hashes of each page with how often the token is on
    it, so tokens of equal fingerprints occur alike and form an equivalence class. A class is valid
    if it has LEAST_TOKENS tokens or more, is on LEAST_ON pages and on support of the host's pages or
    more (each counted once however many copies it has), keeps one order on every page and nests in
    the classes larger than it there (checked_classes). Tokens of valid classes are the constants.
    """
    prepare(pages.sparkSession)

    def sequences(items):
        for batch in batches(items):
            found = [token_sequence(x) for x in texts(batch.column(1))]
            counts = [Counter(t for t, _ in s) for s in found]
            size = [dict(s) for s in found]
            yield pa.RecordBatch.from_pydict({
                "host": batch.column(0),
                "page": pa.array([hashed(x) for x in texts(batch.column(1))], pa.int64()),
                "sequence": pa.array([[t for t, _ in s] for s in found], pa.list_(pa.int64())),
                "tokens": pa.array([[{"token": t, "n": n, "size": z[t]} for t, n in c.items()] for c, z in zip(counts, size, strict=True)], pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int32()), ("size", pa.int32())]))),
            })

    def checked(items):
        for batch in batches(items):
            found: set[tuple] = set()
            for host, sequence, members in zip(batch.column("host").to_pylist(), batch.column("sequence").to_pylist(), batch.column("members").to_pylist(), strict=True):
                classes = {m["token"]: m["class"] for m in members}
                found.update((host, *c) for c in checked_classes(sequence, classes))
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_pydict({"host": pa.array(columns[0], pa.string()), "class": pa.array(columns[1], pa.int64()), "order": pa.array(columns[2], pa.int64()), "ok": pa.array(columns[3], pa.bool_())})

    slim = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    # Only the tokens' hashes cross the network, not the pages; copies of a page count once.
    seen = slim.mapInArrow(sequences, "host string, page long, sequence array<long>, tokens array<struct<token:long,n:int,size:int>>")
    seen = checkpointed(seen.groupBy("host", "page").agg(F.first("sequence").alias("sequence"), F.first("tokens").alias("tokens")))
    sizes = checkpointed(seen.groupBy("host").agg(F.count(F.lit(1)).alias("pages")))
    each = seen.select("host", "page", F.explode("tokens").alias("t")).select("host", "t.token", F.xxhash64("page", "t.n").alias("vector"), "t.size")
    held = each.groupBy("host", "token").agg(F.count(F.lit(1)).alias("on"), F.max("size").alias("size"), F.bit_xor("vector").alias("class"))
    often = held.join(sizes, "host").where((F.col("pages") >= LEAST_PAGES) & (F.col("on") >= F.greatest(F.lit(LEAST_ON), F.lit(support) * F.col("pages"))))
    likely = checkpointed(often.groupBy("host", "class").agg(F.sum("size").alias("size"), F.collect_list("token").alias("tokens")).where(F.col("size") >= LEAST_TOKENS).select("host", "class", "tokens"))
    members = likely.select("host", "class", F.explode("tokens").alias("token")).groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("members"))
    found = with_host(seen.select("host", "sequence"), members, sizes, "members", "inner").mapInArrow(checked, "host string, class long, order long, ok boolean")
    valid = found.groupBy("host", "class").agg(F.min("order").alias("least"), F.max("order").alias("most"), F.min("ok").alias("ok")).where("ok and least = most")
    template = likely.join(valid.select("host", "class"), ["host", "class"]).groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    return checkpointed(template), sizes


def slots(html: str, constants: frozenset) -> list[str]:
    """The texts of a page's slots that hold the article, in page order."""
    held = [b for b in blocks(html) if not b.outside and (b.main or not b.links)]
    if any(b.main for b in held):
        held = [b for b in held if b.main]
    kept = [b.text for b in held if not constants or text_token(b) not in constants]
    return kept or [b.text for b in held]


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page.

    Pages of one host share a template. Its constants are deduced from equivalence classes of tokens
    (template_tokens); the gaps between them, where the other blocks stand, are the slots.
    Slots under elements that stand for menus, headers, footers, sidebars, notices, adverts, forms
    or comments, by element, class, id or role, hold no article, nor do blocks made of links that are
    no paragraphs or headings; if the page has an article or main element, only slots in it count. The
    blocks of the remaining slots are the text, joined by an empty line, with character references
    decoded and white space inside a block as one space; an advert inside a line is left out of it.
    Constant texts are left out unless nothing else would remain.

    A host with fewer than LEAST_PAGES distinct pages has no deduced texts. Copies of a page count
    once. Null, empty and broken pages give what text they have, or an empty one; a null url is a
    host of its own; rows repeat as in pages; other columns are not returned. The time for a page is
    linear in its length. Pages are never grouped and, unless the templates are many, never moved:
    hashes of their tokens are summed up, and the few constants of each host go to its pages.
    """
    template, sizes = template_tokens(pages, url, html)
    kinds = dict(pages.dtypes)
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    rows = with_host(rows, template, sizes, "tokens", "left").select("page_id", "url", "html", "tokens")

    def extracted(items):
        for batch in batches(items):
            out = ["\n\n".join(slots(x, frozenset(known or ()))) for x, known in zip(texts(batch.column(2)), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(out, pa.string()), "n_chars": pa.array([len(t) for t in out], pa.int64())})

    return rows.mapInArrow(extracted, f"page_id {kinds[key]}, url {kinds[url]}, text string, n_chars long")
