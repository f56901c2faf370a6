"""Main text of web pages, with a suffix array of each host's pages against boilerplate.

A page is read into blocks of text by its tags. Blocks inside chrome (navigation, footers, forms, asides and the like, by tag, role or class) are
declared boilerplate; of the others, those in the page's articles are article blocks (a main region stands in where there is none).

The blocks of all pages of a host go into one concatenation of token streams: a page's article blocks each as a stream, all its other blocks together as
one. Its suffixes are ranked by prefix doubling, to the depth of the longest run asked for; suffixes of equal rank at depth d stand together in the suffix
array and share d tokens, and the tokens under such windows are those under all longer repeats. Two kinds of long substrings are boilerplate:

- outside articles, runs of MIN_RUN tokens that MIN_PAGES pages of the host have. Equal pages count once; pages that differ only in their articles differ.
- in articles, runs of ARTICLE_RUN tokens that MIN_PAGES articles have which are no copies of each other. Near copies count once, mostly: articles are
  told apart by the smallest key of their runs of MIN_RUN tokens. Where such runs make up more than half of an article, it is a copy and stays whole.

Covered tokens go, unique runs stay, whether a page declares an article or not. Of a page with articles the text is what is left of them; of a page
without, what is left of all blocks that aren't declared chrome (a block that is covered but for a few words goes with them, one that a run only
reaches into stays whole). Neither number grows with the host.

A host of more than SHARD_PAGES pages or SHARD_BYTES is dealt into shards by a hash of the page; a shard that copies of a row crowd is dealt once more, by
where they stand. For such hosts runs are counted by key over the whole host, and each shard gets the frequent ones that it has, so its answer is that of
one array over the host. Windows in articles are many; so their anchors are counted first (the least key of 8 tokens among those of each window, which
all pages that have the window choose alike), and windows only around frequent anchors; runs outside articles only for hosts that have a page without
articles, as others don't need them. For that the pages of such hosts are parsed two times more.

Cases: null html is empty, with empty text; a null url is a host of its own name, the empty one; broken and cut-off markup is read as far as it goes;
repeated rows get equal results, and are dealt over shards like other rows; an empty table gives an empty result. Other columns are not read, whatever
their names. A page is read in one piece: it needs some ten times its size.
"""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm import textbatch as tb
from tilewright.llm.shared import stage_table

MIN_RUN = 8
ARTICLE_RUN = 50
MIN_PAGES = 4
SHARD_PAGES = 1000
SHARD_BYTES = 8 << 20
BROADCAST_HOSTS = 100_000
#: Frequent anchors that are sent to the tasks; beyond that number all windows are counted.
BROADCAST_ANCHORS = 1 << 20
#: Kinds of blocks.
OUTSIDE, CHROME_BLOCK, ARTICLE = 0, 1, 2
BARE = -1

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
CHROME = frozenset("aside button datalist dialog fieldset footer form head iframe label menu nav noscript object option search select template title".split())
#: Their content isn't markup.
RAW = ("script", "style", "textarea", "svg", "math", "canvas", "noembed", "noframes")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMES = frozenset(
    """ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright
    discussion disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion
    recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget""".split()
)
#: Names of classes that only say what a container goes with.
WITH = ("has-", "with-", "no-", "without-", "has_", "with_", "no_")
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("article aside body dd div dl dt fieldset footer form header html li main nav ol section table td th tr ul".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[a-z/!?][^>]*(?:>|\Z)|[^<]+|<",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
BODY_NAMES = frozenset("articlebody article-body article-content entry-content post-content post-body story-body main-content".split())


def _attributes(text: str) -> dict[str, str]:
    return {name.lower(): value.strip("\"'").lower() for name, value in ATTRIBUTE.findall(text)} if text.strip(" /") else {}


def _is_chrome(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in CHROME or (tag == "header" and not in_article):
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")) or attrs.get("role") in ROLES:
        return True
    if tag in ("html", "body", "main"):
        return False
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        parts = re.split(r"[^a-z0-9]+", re.sub(r"^(?:article|post|entry|story)[-_](?=header$)", "", name))
        if not name.startswith(WITH) and (NAMES.intersection(parts) or (not in_article and "header" in parts)):
            return True
    return False


def read_blocks(page: str | None) -> list[tuple[str, int, bool]]:
    """(text, article, chrome) of each block in page order. article: its number from 1, 0 outside; -1 in a main region outside articles."""
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, int, bool, bool]] = []  # tag, article, chrome, in an article's header
    parts: list[str] = []
    articles = 0
    article, chrome, header = 0, False, False

    def flush(heading: bool = False) -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append((text, article, chrome or (header and not heading)))

    def pop_to(k: int) -> None:
        nonlocal article, chrome, header
        del stack[k:]
        _, article, chrome, header = stack[-1] if stack else ("", 0, False, False)

    for m in TOKEN.finditer(page or ""):
        tag = m["tag"]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                parts.append(html.unescape(text) if "&" in text else text)
            continue
        tag = tag.lower()
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        block = tag in BLOCK
        if m["close"]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if block:
                flush(tag in HEADINGS)
            elif tag in ("td", "th"):
                parts.append(" ")
            if k is not None and (block or not any(s[0] in SCOPE for s in stack[k + 1 :])):
                if not block and chrome and not (stack[k - 1][2] if k else False):
                    flush()
                pop_to(k)
            continue
        attrs = _attributes(m["attrs"])
        if block:
            flush()
        elif tag in ("td", "th"):
            parts.append(" ")
        ends = CLOSES.get(tag, {"p"} if block else ())
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in ends:
                pop_to(k)
                break
            if stack[k][0] in SCOPE:
                break
        if m["attrs"].endswith("/") and not block:
            continue
        mine = _is_chrome(tag, attrs, article > 0)
        if not block and mine and not chrome:
            flush()
        if not article > 0 and not (chrome or mine):
            names = {attrs.get("itemprop", ""), attrs.get("id", ""), *attrs.get("class", "").split()}
            if tag == "article" or BODY_NAMES & names:
                articles += 1
                article = articles
            elif tag == "main" or attrs.get("role") == "main":
                article = -1
        chrome, header = chrome or mine, header or (tag == "header" and article > 0)
        stack.append((tag, article, chrome, header))
    flush()
    return out


def page_parts(page: str | None) -> tuple[list[str], list[int]]:
    """The blocks of a page and their kinds. All articles are article blocks; a main region only where there is no article."""
    blocks = read_blocks(page)
    region = any(article > 0 and not chrome for _, article, chrome in blocks)
    inside = [(article > 0 if region else article == -1) and not chrome for _, article, chrome in blocks]
    return [t for t, _, _ in blocks], [ARTICLE if own else CHROME_BLOCK if chrome else OUTSIDE for own, (_, _, chrome) in zip(inside, blocks, strict=True)]


def run_ranks(tokens: np.ndarray, depths: tuple[int, ...]) -> list[np.ndarray]:
    """Ranks of the suffixes of a row of tokens by their first d tokens, for each d of depths in ascending order; what is beyond the end sorts first."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    depth, out = 1, []
    for wanted in depths:
        while depth < wanted:
            step = min(depth, wanted - depth)
            ahead = np.full(len(rank), -1, np.int64)
            ahead[: max(len(rank) - step, 0)] = rank[step:]
            rank = np.unique(rank * (ahead.max(initial=0) + 2) + ahead + 1, return_inverse=True)[1].astype(np.int64)
            depth += step
        out.append(rank)
    return out


def cover(first: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions lie in windows that begin where `first` is true."""
    at = np.flatnonzero(first)
    mark = np.bincount(at, minlength=n + 1) - np.bincount(np.minimum(at + length, n), minlength=n + 1)
    return np.cumsum(mark[:n]) > 0


class Streams:
    """The token streams of pages: for each page its blocks outside articles as one, then each article block.

    tokens: 64-bit hashes; bounds: tokens before each stream; page: whose it is; inside: whether it is an article block.
    """

    def __init__(self, pages: list[tuple[list[str], list[int]]]):
        texts, self.page, self.inside = [], [], []
        for k, (blocks, kinds) in enumerate(pages):
            texts.append(" ".join(b for b, kind in zip(blocks, kinds, strict=True) if kind != ARTICLE))
            own = [b for b, kind in zip(blocks, kinds, strict=True) if kind == ARTICLE]
            texts += own
            self.page += [k] * (1 + len(own))
            self.inside += [False] + [True] * len(own)
        self.page, self.inside = np.array(self.page, np.int64), np.array(self.inside, bool)
        words = tb.Words(*tb.raw(pa.array(texts, pa.large_string())))
        self.tokens, self.bounds = words.hashes(), words.bounds
        self.stream_of = words.text_of

    def windows(self, length: int, inside: bool) -> tuple[np.ndarray, np.ndarray]:
        """(key, first token) of each window of the streams of one kind."""
        key, first = tb.windows(self.tokens, self.bounds, length)
        use = self.inside[self.stream_of[first]] == inside
        return key[use], first[use]

    def signatures(self, pages: int) -> np.ndarray:
        """A key of each page's article by which copies and most near copies are told: the least of its runs', or the sum of its tokens'."""
        key, first = self.windows(MIN_RUN, True)
        none = np.uint64(0xFFFFFFFFFFFFFFFF)
        out = np.full(pages, none)
        np.minimum.at(out, self.page[self.stream_of[first]], key)
        total = np.zeros(pages, np.uint64)
        use = self.inside[self.stream_of]
        np.add.at(total, self.page[self.stream_of[use]], self.tokens[use])
        return np.where(out == none, total, out).view(np.int64)

    def anchors(self) -> np.ndarray:
        """The least key of MIN_RUN tokens of each window of ARTICLE_RUN in articles, once a stream: (stream, key) pairs."""
        key, first = self.windows(MIN_RUN, True)
        stream = self.stream_of[first]
        wide = ARTICLE_RUN - MIN_RUN + 1
        if len(key) < wide:
            return np.zeros((0, 2), np.uint64)
        seen = np.lib.stride_tricks.sliding_window_view(key, wide).min(1)
        whole = stream[wide - 1 :] == stream[: len(stream) - wide + 1]
        return np.unique(np.column_stack((stream[: len(seen)][whole].astype(np.uint64), seen[whole])), axis=0)


def repeated_tokens(streams: Streams, pages: int, content: np.ndarray, frequent: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """Which tokens are covered by runs that are boilerplate. content: a number for each page, equal for equal pages; frequent: keys by length of such
    runs of the whole host."""
    n = len(streams.tokens)
    out = np.zeros(n, bool)
    if not n:
        return out
    # a separator of its own after each stream
    count = len(streams.bounds) - 1
    place = np.arange(n) + streams.stream_of
    tokens = np.unique(streams.tokens, return_inverse=True)[1].astype(np.int64)
    row = np.full(n + count, -1, np.int64)
    row[place] = tokens
    gaps = np.flatnonzero(row < 0)
    row[gaps] = tokens.max() + 1 + np.arange(len(gaps))
    owners = (content, np.unique(streams.signatures(pages), return_inverse=True)[1])
    for length, rank, owner, inside in zip((MIN_RUN, ARTICLE_RUN), run_ranks(row, (MIN_RUN, ARTICLE_RUN)), owners, (False, True), strict=True):
        key, first = streams.windows(length, inside)
        if not len(first):
            continue
        mine = np.unique(rank[place[first]], return_inverse=True)[1]
        many = int(owner.max()) + 1
        pairs = np.unique(mine * many + owner[streams.page[streams.stream_of[first]]])
        often = np.bincount(pairs // many)[mine] >= MIN_PAGES
        if frequent is not None:
            often |= np.isin(key.view(np.int64), frequent[length])
        start = np.zeros(n, bool)
        start[first[often]] = True
        out |= cover(start, length, n)
    # an article of which more than half is covered is a copy
    own = streams.inside[streams.stream_of]
    page = streams.page[streams.stream_of]
    copies = 2 * np.bincount(page[own & out], minlength=pages) > np.bincount(page[own], minlength=pages)
    return out & ~(own & copies[page])


def long_stretches(mask: np.ndarray) -> np.ndarray:
    """Only the stretches of a run's length and more: a run that reaches a few words into a block of its own leaves it whole."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    out = np.zeros(len(mask), bool)
    for start, end in zip(edges[::2], edges[1::2], strict=True):
        out[start:end] = end - start >= MIN_RUN
    return out


def shard_texts(pages: list[tuple[list[str], list[int]]], frequent: dict[int, np.ndarray] | None = None) -> list[str]:
    """The texts of a shard's pages; frequent holds keys of runs that the whole host repeats, by length."""
    known: dict[tuple, int] = {}
    content = [known.setdefault((tuple(b), tuple(k)), len(known)) for b, k in pages]
    distinct = [(list(b), list(k)) for b, k in known]
    streams = Streams(distinct)
    covered = repeated_tokens(streams, len(distinct), np.arange(len(distinct)), frequent)
    texts = []
    stream = 0
    for blocks, kinds in distinct:
        outside = covered[streams.bounds[stream] : streams.bounds[stream + 1]]
        stream += 1
        at, kept, region = 0, [], ARTICLE in kinds
        for block, kind in zip(blocks, kinds, strict=True):
            if kind == ARTICLE:
                mask = covered[streams.bounds[stream] : streams.bounds[stream + 1]]
                stream += 1
            else:
                size = block.count(" ") + 1
                mask = outside[at : at + size]
                at += size
                if region or kind == CHROME_BLOCK:
                    continue
            if not mask.any():
                kept.append(block)
            elif not mask.all():
                drop = long_stretches(mask)
                kept.append(" ".join(w for w, c in zip(block.split(" "), drop, strict=True) if not c))
        texts.append("\n".join(kept))
    return [texts[c] for c in content]


def host_of(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _host_runs(pages: DataFrame, lengths: tuple[int, ...], near: np.ndarray | None = None) -> DataFrame:
    """(host, length, run, shards) of runs that MIN_PAGES pages of a host have, with the shards that have them, of pages (host, shard, html, bare).

    lengths: MIN_RUN, runs outside articles of bare hosts, those with a page without articles (no other page needs them); 0, anchors of windows in
    articles; ARTICLE_RUN, windows in articles, only such around the anchors `near` if given; BARE, a row for each host that has a page without articles.
    """

    def of(streams: Streams, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(stream, key) of runs."""
        if length == BARE:
            one = np.flatnonzero(~streams.inside & (np.bincount(streams.page[streams.inside], minlength=streams.page[-1] + 1) == 0)[streams.page])
            return one, np.zeros(len(one), np.uint64)
        if not length:
            pairs = streams.anchors()
            return pairs[:, 0].astype(np.int64), pairs[:, 1]
        key, first = streams.windows(length, length == ARTICLE_RUN)
        if length == ARTICLE_RUN and near is not None:
            short, at = streams.windows(MIN_RUN, True)
            start = np.zeros(len(streams.tokens) + 1, np.int64)
            start[at[np.isin(short.view(np.int64), near)]] = 1
            held = np.concatenate(([0], np.cumsum(start)))
            use = held[np.minimum(first + ARTICLE_RUN - MIN_RUN + 1, len(held) - 1)] > held[first]
            key, first = key[use], first[use]
        return streams.stream_of[first], key

    def runs(batches):
        for batch in batches:
            found = [page_parts(x) for x in batch.column(2).to_pylist()]
            if not found:
                continue
            streams = Streams(found)
            bare = batch.column(3).to_numpy(zero_copy_only=False)
            for length in lengths:
                if length == MIN_RUN and not bare.any():
                    continue
                # pages by their blocks, articles by their signatures, in 32 bits
                owner = np.array([hash_blocks(b, k) for b, k in found], np.int64) if length == MIN_RUN else streams.signatures(len(found))
                stream, key = of(streams, length)
                if length == MIN_RUN:
                    use = bare[streams.page[stream]]
                    stream, key = stream[use], key[use]
                rows = np.unique(np.column_stack((streams.page[stream], key.view(np.int64))), axis=0)
                place = pa.array(rows[:, 0])
                yield pa.record_batch([batch.column(0).take(place), batch.column(1).take(place), pa.array(np.full(len(rows), length, np.int32)), pa.array(rows[:, 1]), pa.array((owner[rows[:, 0]] & 0x7FFFFFFF).astype(np.int32))], names=["host", "shard", "length", "run", "owner"])

    found = pages.mapInArrow(runs, "host string, shard bigint, length int, run bigint, owner int")
    # of each shard the first MIN_PAGES owners are enough to know that a run is frequent, and all of a shard with fewer
    kept = found.groupBy("host", "shard", "length", "run").agg(F.collect_set("owner").alias("owners")).withColumn("owners", F.slice("owners", 1, MIN_PAGES))
    whole = kept.groupBy("host", "length", "run").agg(F.collect_set("shard").alias("shards"), F.size(F.array_distinct(F.flatten(F.collect_list("owners")))).alias("n"))
    return whole.where((F.col("n") >= MIN_PAGES) | (F.col("length") == BARE)).drop("n")


def hash_blocks(blocks: list[str], kinds: list[int]) -> int:
    """A 64-bit key of a page's blocks."""
    text = "\n".join(f"{k}{b}" for b, k in zip(blocks, kinds, strict=True))
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    sizes = pages.select(host_of(url).alias("host"), F.coalesce(F.octet_length(source), F.lit(0)).alias("bytes")).groupBy("host").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    shards = F.greatest(F.ceil(F.col("n") / SHARD_PAGES), F.ceil(F.col("bytes") / SHARD_BYTES))
    hot = stage_table(sizes.select("host", shards.alias("shards")).where("shards > 1"), "hosts")
    count = hot.count()
    near_hot = F.broadcast(hot) if count <= BROADCAST_HOSTS else hot
    schema = T.StructType([pages.schema[page_id], pages.schema[url], T.StructField("host", T.StringType()), T.StructField("hash", T.LongType()), T.StructField("blocks", T.ArrayType(T.StringType())), T.StructField("kinds", T.StringType())])

    def parse(batches):
        for batch in batches:
            found = [page_parts(x) for x in batch.column(4).to_pylist()]
            kinds = pa.array(["".join(map(str, k)) for _, k in found], pa.string())  # a digit for each block
            yield pa.record_batch([*batch.columns[:4], pa.array([b for b, _ in found], pa.list_(pa.string())), kinds], names=schema.names)

    parsed = pages.select(page_id, url, host_of(url).alias("host"), F.xxhash64(page_id, url, source).alias("hash"), source).mapInArrow(parse, schema)
    dealt = parsed.join(near_hot, "host", "left").withColumn("shard", F.pmod("hash", F.coalesce("shards", F.lit(1)))).drop("hash", "shards")
    result = T.StructType([pages.schema[page_id], pages.schema[url], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def texts(table: pa.Table, frequent: dict[int, np.ndarray] | None = None) -> pa.Table:
        found = shard_texts([(b, list(map(int, k))) for b, k in zip(table["blocks"].to_pylist(), table["kinds"].to_pylist(), strict=True)], frequent)
        return pa.table([table[page_id], table[url], pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=result.names)

    alone = lambda table: texts(table)  # noqa: E731  Spark looks at the number of parameters
    if not count:
        return dealt.groupBy("host", "shard").applyInArrow(alone, result)
    large = pages.select(host_of(url).alias("host"), F.xxhash64(page_id, url, source).alias("hash"), F.col(source).alias("html")).join(near_hot, "host").select("host", F.pmod("hash", "shards").alias("shard"), "html")
    crowded = stage_table(large.groupBy("host", "shard").count().where(F.col("count") > 3 * SHARD_PAGES).select("host", "shard", F.ceil(F.col("count") / SHARD_PAGES).alias("parts")), "crowded")
    parts = F.broadcast(crowded) if crowded.count() <= BROADCAST_HOSTS else crowded
    first = stage_table(_host_runs(large.withColumn("bare", F.lit(False)), (BARE, 0)), "runs")
    anchors = first.where("length = 0").select("run").distinct()
    count = anchors.count()
    near = anchors.toArrow()["run"].to_numpy() if count <= BROADCAST_ANCHORS else None
    bare = first.where(F.col("length") == BARE).select("host", F.lit(True).alias("bare"))
    lengths = (MIN_RUN,) * (not bare.isEmpty()) + (ARTICLE_RUN,) * (count > 0)
    # which part a row goes to makes no difference to its text
    dealt = dealt.join(parts, ["host", "shard"], "left").withColumn("part", F.pmod(F.monotonically_increasing_id(), F.coalesce("parts", F.lit(1)))).drop("parts")
    if not lengths:
        return dealt.groupBy("host", "shard", "part").applyInArrow(alone, result)
    told = F.broadcast(bare) if bare.count() <= BROADCAST_HOSTS else bare
    asked = large.join(told, "host", "left").select("host", "shard", "html", F.coalesce("bare", F.lit(False)).alias("bare"))
    often = _host_runs(asked, lengths, near)
    often = often.select("host", "length", "run", F.explode("shards").alias("shard")).join(parts, ["host", "shard"], "left")
    often = often.select("host", "shard", "length", "run", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        length, run = right["length"].to_numpy(), right["run"].to_numpy()
        return texts(left, {k: run[length == k] for k in (MIN_RUN, ARTICLE_RUN)}) if len(left) else result_of_none(result)

    return dealt.groupBy("host", "shard", "part").cogroup(often.groupBy("host", "shard", "part")).applyInArrow(both, result)


def result_of_none(schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).empty_table()
