"""Language identification of pages by Bayesian evidence fusion.

Evidence for each language: the likelihood of the page's visible text under hashed byte trigrams learned from labelled
documents; the language that the markup declares, weighed by how often pages of each language declare it; and a prior
from the page's host, smoothed towards its domain, its address suffix and the whole table. The declaration rates and
the priors come from the pages themselves by grouped aggregation of posteriors, without the page's own share.
"""

from __future__ import annotations

import html
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fitted, materialize, scratch, sliced, table
from .textscan import letter_tables, mixed

BITS = 16
SAMPLE_DOCS = 1_000  # documents of each language
MOST_LANGUAGES = 256  # more are refused: the model is broadcast
SMOOTH = 0.3
#: Trigrams that count in full; the evidence of longer texts grows with their root.
FULL_TRIGRAMS = 60
PULL = 4.0  # how many pages of its parent a host, domain or suffix counts for

_HIDE = (b"script", b"style", b"noscript", b"template", b"head", b"nav", b"footer", b"aside")
_HIDDEN = re.compile(rb"(?i)<(?:(" + b"|".join(_HIDE) + rb")\b|!--)")
_CLOSES = {name: re.compile(rb"(?i)</" + name + rb"\s*>") for name in (*_HIDE, b"article", b"main")}
_MAIN = re.compile(rb"(?i)<(article|main)\b")
_TAG = re.compile(rb"<[^>]*>")
_HTML = re.compile(rb"(?i)<html\b")
_META = re.compile(rb"(?i)<meta\b")
_LANG = re.compile(rb"(?i)\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b")
_CONTENT_LANGUAGE = re.compile(rb"(?i)content-language")
_CONTENT = re.compile(rb"(?i)content\s*=\s*[\"']?\s*([a-z]{2,3})\b")


def _without_hidden(page: bytes) -> bytes:
    """The page without comments and elements that aren't read. One that never closes hides nothing; that it doesn't is
    found once for each name, so the scan is linear whatever the page."""
    out, at, copied, open_for_ever = [], 0, 0, set()
    while m := _HIDDEN.search(page, at):
        name, at = (m[1] or b"").lower(), m.end()
        if name in open_for_ever:
            continue
        if name:
            close = _CLOSES[name].search(page, at)
            end = close.end() if close else -1
        else:
            end = page.find(b"-->", at) + 3 if page.find(b"-->", at) >= 0 else -1
        if end < 0:
            open_for_ever.add(name)
            continue
        out += [page[copied : m.start()], b" "]
        at = copied = end
    return b"".join([*out, page[copied:]])


def _main_part(page: bytes) -> bytes:
    """From the first <article> or <main> that closes to the last such close, or the whole page."""
    last = {}
    for m in _MAIN.finditer(page):
        name = m[1].lower()
        if name not in last:
            last[name] = max((c.start() for c in _CLOSES[name].finditer(page)), default=-1)
        begin = page.find(b">", m.end()) + 1
        if begin and begin <= last[name]:
            return page[begin : last[name]]
    return page


def visible(page: bytes) -> bytes:
    """Text of a page's main part (that is the feature: navigation and the like says little of a page's language), or of
    its body if it marks none; entities are decoded. Linear in the page's length."""
    shown = _main_part(_without_hidden(page))
    closed = shown.rfind(b">") + 1  # no tag ends after it, so none is looked for there
    text = _TAG.sub(b" ", shown[:closed]) + shown[closed:]
    return html.unescape(text.decode("utf-8", "replace")).encode() if b"&" in text else text


def declared(page: bytes) -> str | None:
    """The language that the first html tag declares, else the first content-language of a meta tag."""
    found = None
    if m := _HTML.search(page):
        end = page.find(b">", m.end())
        found = _LANG.search(page, m.end(), end if end >= 0 else len(page))
    for m in () if found else _META.finditer(page):
        end = page.find(b">", m.end())
        if end < 0:
            break
        if said := _CONTENT_LANGUAGE.search(page, m.end(), end):
            if found := _CONTENT.search(page, said.end(), end):
                break
    return found[1].decode().lower() if found else None


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each trigram of lower-cased bytes, n+1 offsets). Runs of other bytes than letters are one space."""
    low, word = letter_tables()
    letters = low.copy()
    letters[~word] = 32
    letters[48:58] = 32
    buf = letters[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    text_of = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], ends])))
    kept = np.ones(len(buf), bool)
    kept[1:] = (buf[1:] != 32) | (buf[:-1] != 32) | (text_of[1:] != text_of[:-1])
    b, t = buf[kept].astype(np.uint64), text_of[kept]
    same = t[2:] == t[:-2]
    code = (b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:])[same]
    at = (mixed(code) >> np.uint64(64 - BITS)).astype(np.int64)
    return at, np.searchsorted(t[2:][same], np.arange(len(texts) + 1))


class Model:
    """languages and the log probability of each trigram bucket in each (buckets, languages)."""

    def __init__(self, languages: list[str], logs: np.ndarray):
        self.languages, self.logs = languages, logs

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, languages=np.array(self.languages, dtype=str), logs=self.logs)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Model:
        with np.load(io.BytesIO(data)) as got:
            return cls(got["languages"].tolist(), got["logs"])

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """Log likelihoods (texts, languages), damped for long texts, whose trigrams are not independent."""
        if not self.languages:
            return np.zeros((len(texts), 0))
        at, off = trigrams(texts)
        sums = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(self.logs[at], axis=0, dtype=np.float64)])
        n = np.diff(off)
        mean = (sums[off[1:]] - sums[off[:-1]]) / np.maximum(n, 1)[:, None]
        return mean * np.minimum(n, np.sqrt(FULL_TRIGRAMS * n))[:, None]


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in sliced(iter([batch]), "text", 2 << 20):
            langs = np.array(part.column("lang").to_pylist(), dtype=object)
            at, off = trigrams([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()])
            row = np.repeat(np.arange(len(langs)), np.diff(off))
            for lang in sorted(set(langs)):
                new = np.bincount(at[langs[row] == lang], minlength=1 << BITS)
                counts[lang] = counts.get(lang, 0) + new
    kept = sorted(counts)
    logs = np.stack([np.log((counts[k] + SMOOTH) / (counts[k].sum() + SMOOTH * (1 << BITS))) for k in kept], axis=1) if kept else np.zeros((1 << BITS, 0))
    yield pa.record_batch([pa.array([Model(kept, logs.astype(np.float32)).dump()], pa.binary())], names=["model"])


def train(docs: DataFrame, sample: int = SAMPLE_DOCS) -> bytes:
    """The text model of every language that docs has, fitted in one task on about `sample` different documents of each:
    all whose hash lies below the share of the language that makes so many. Over MOST_LANGUAGES languages are refused."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    shares = usable.groupBy("lang").agg(F.count("*").alias("docs"))
    if (languages := shares.limit(MOST_LANGUAGES + 1).count()) > MOST_LANGUAGES:
        raise ValueError(f"{languages} languages or more; at most {MOST_LANGUAGES} are told apart")
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32))
    chosen = usable.join(F.broadcast(shares), "lang").where(draw * F.col("docs") < sample * (1 << 32))
    rows = chosen.groupBy("lang", "doc_id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    return fitted(rows.select("lang", "text"), _fit_rows)


def _page_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.load(model.value)
        for batch in sliced(batches, "html", 2 << 20):
            pages = [x or b"" for x in batch.column("html").cast(pa.binary()).to_pylist()]
            e = m.evidence([visible(p) for p in pages])
            rows = pa.array(list(e), pa.list_(pa.float64()))
            yield pa.record_batch([batch.column("page_id"), batch.column("host"), pa.array([declared(p) for p in pages], pa.string()), rows], names=["page_id", "host", "declared", "evidence"])

    return run


def _posterior(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(axis=1, keepdims=True, initial=-np.inf)) if logs.shape[1] else logs
    return p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), width)


def _shares(rates, width: int):
    """Adds joint, evidence and declaration together, and share, the posterior from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = rates.value  # a row for each name, then for other declarations and for none
        place = {n: i for i, n in enumerate(names)} | {None: len(names) + 1}
        for b in batches:
            said = np.array([place.get(x, len(names)) for x in b.column("declared").to_pylist()], np.int64)
            joint = _matrix(b.column("evidence"), width) + logs[said]
            more = [pa.array(list(x), pa.list_(pa.float64())) for x in (joint, _posterior(joint))]
            yield pa.record_batch([*b.columns, *more], names=[*b.schema.names, "joint", "share"])

    return run


def _fused(languages: list[str]):
    width = len(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = _matrix(b.column("share"), width)
            prior = np.full(own.shape, 1 / max(width, 1))
            for level in ("everywhere", "suffix_sum", "domain_sum", "host_sum"):
                others = np.maximum(_matrix(b.column(level), width) - own, 0)
                prior = (others + PULL * prior) / (others.sum(axis=1, keepdims=True) + PULL)
            p = _posterior(_matrix(b.column("joint"), width) + np.log(np.maximum(prior, 1e-12)))
            text = _matrix(b.column("evidence"), width).argmax(axis=1) if width else np.zeros(len(p), np.int64)
            best = p.argmax(axis=1) if width else text
            name = lambda at: pa.array([languages[i] for i in at] if width else [None] * len(at), pa.string())
            top = p.max(axis=1) if width else np.zeros(len(p))
            yield pa.record_batch([b.column("page_id"), b.column("host"), b.column("declared"), name(text), name(best), pa.array(top)], names=["page_id", "host", "declared", "text_lang", "lang", "posterior"])

    return run


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _summed(rows: DataFrame, by: str, width: int, name: str) -> DataFrame:
    parts = [F.sum(F.round(F.col("share")[i] * 1e6).cast("bigint")).alias(f"s{i}") for i in range(width)]
    sums = rows.groupBy(by).agg(F.count("*").alias("pages"), *parts)
    return sums.select(by, F.transform(F.array(*(F.col(f"s{i}") for i in range(width))) if width else F.array().cast("array<bigint>"), lambda x: x / 1e6).alias(name))


def identify(pages: DataFrame, docs: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """(page_id, host, declared, text_lang, lang, posterior) for every row of pages (page_id, url, html).

    Null html is an empty page, decided by its declaration and priors; a url without a host has the host ''. Pages of any
    length are read whole, in one forward scan. Repeated
    rows each get a result and count each for the priors. Without labelled documents lang is null and posterior 0. An
    empty table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    data = train(docs, sample)
    languages = Model.load(data).languages
    width = len(languages)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
    kinds = "page_id bigint, host string, declared string, evidence array<double>"
    keep: list[DataFrame] = []
    with scratch(keep=keep):
        seen = materialize(rows.mapInArrow(_page_rows(spark.sparkContext.broadcast(data)), kinds), "lang-pages")
        # How often pages of each language declare each of the languages, another one, or none.
        said = F.when(F.col("declared").isin(languages), F.col("declared")).when(F.col("declared").isNotNull(), "other")
        by_text = spark.sparkContext.broadcast((languages, np.zeros((width + 2, width))))
        both = f"{kinds}, joint array<double>, share array<double>"
        first = seen.mapInArrow(_shares(by_text, width), both).withColumn("said", said)
        told = {r["said"]: np.array(r["sums"], float) for r in _summed(first, "said", width, "sums").collect()}  # a row for each language, other and none
        counts = np.stack([told.get(n, np.zeros(width)) + 0.5 for n in (*languages, "other", None)])
        rates = spark.sparkContext.broadcast((languages, np.log(counts / counts.sum(axis=0, keepdims=True))))
        shared = seen.mapInArrow(_shares(rates, width), both)
        labels = F.split("host", r"\.")
        placed = shared.withColumns({"suffix": F.element_at(labels, -1), "domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")})
        placed = materialize(placed, "lang-shares")
        hosts = materialize(_summed(placed, "host", width, "host_sum").join(placed.groupBy("host").agg(F.first("suffix").alias("suffix"), F.first("domain").alias("domain")), "host"), "lang-hosts")
        domains = materialize(_summed(placed, "domain", width, "domain_sum"), "lang-domains")
        suffixes = materialize(_summed(placed, "suffix", width, "suffix_sum"), "lang-suffixes")
        whole = _summed(placed.withColumn("all", F.lit(0)), "all", width, "everywhere").drop("all")
        named = hosts.join(domains, "domain").join(suffixes, "suffix").crossJoin(F.broadcast(whole))
        named = materialize(named.select("host", "host_sum", "domain_sum", "suffix_sum", "everywhere"), "lang-priors")
        keep += [placed, named]
    full = placed.select("page_id", "host", "declared", "evidence", "joint", "share").join(named, "host")
    return full.mapInArrow(_fused(languages), "page_id bigint, host string, declared string, text_lang string, lang string, posterior double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
