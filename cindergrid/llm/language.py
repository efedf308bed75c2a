"""Operator 3: language identification by Bayesian fusion of evidence.

For each row the posterior over the model's languages multiplies

* the *text likelihood*: hashed byte trigrams under a smoothed multinomial
  per language, tempered because neighbouring trigrams overlap;
* the *declared language* (``<html lang>``): how often texts of a language
  declare it, counted over all rows;
* the *prior of the address*: a chain of Dirichlet-smoothed shares, all
  rows -> address suffix -> registered domain -> host, where each level
  leans on the one above as far as its own rows are few.  A row's own text
  is taken out of every level before it is scored.

The shares and the declaration table are grouped aggregates of the text-only
posteriors of all rows.  The text model is fitted on a bounded number of
distinct labelled texts of each language (``max_rows``).  A text that none of
its languages explains is in none of them: it is undetermined and counts
nowhere.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindergrid.llm.common import bounded_batches, materialised

BUCKETS = 1 << 16
UNDETERMINED = "und"

# ASCII characters that aren't letters become spaces; bytes over 127 stay.
_SPACES = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def trigram_buckets(text: str | None) -> np.ndarray:
    """Hash bucket of every byte trigram of the lower-cased words, with a space before, between and after them."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACES).split()
    if not raw:
        return np.empty(0, np.int64)
    a = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8).astype(np.uint32)
    return (((a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


# --- the text model ------------------------------------------------------


@dataclass
class TextModel:
    """Log-probabilities of the trigram buckets, one row per language."""

    languages: tuple[str, ...]
    logs: np.ndarray
    longest: float = 100.0

    share: float = 0.35
    slack: float = 5.5

    def __post_init__(self):
        # a text's mean per trigram under its own language is near the language's negative entropy,
        # and near the uniform one where the language doesn't know it
        uniform = -math.log(BUCKETS)
        logs = self.logs.astype(np.float64)
        self.floors = uniform + self.share * np.maximum((np.exp(logs) * logs).sum(axis=1) - uniform, 0.0)

    def log_likelihoods(self, text: str | None) -> tuple[int, np.ndarray]:
        """Number of trigrams, and tempered log-likelihoods less their largest.

        A text in none of the languages has its number of trigrams negative
        and likelihoods that are all alike: under the likeliest language its
        mean per trigram is below that language's floor, ``share`` of the way
        from uniform trigrams to what the language's own texts have.
        """
        found = trigram_buckets(text)
        if not len(found) or not self.languages:
            return len(found), np.zeros(len(self.languages))
        counts = np.bincount(found, minlength=BUCKETS) if len(found) > BUCKETS else None
        mean = (self.logs @ counts if counts is not None else self.logs[:, found].sum(axis=1)) / len(found)
        best = int(mean.argmax())
        # the mean of few trigrams varies, so short texts have a lower floor
        if mean[best] < self.floors[best] - self.slack / math.sqrt(len(found)):
            return -len(found), np.zeros(len(self.languages))
        total = mean * min(len(found) / 3.0, self.longest)
        return len(found), total - total.max()


def fit_text_model(texts: DataFrame, *, text: str = "text", language: str = "lang", max_rows: int = 8_000,
                   smoothing: float = 0.5) -> TextModel:
    """Fit on at most ``max_rows`` distinct texts of each language, chosen by the hash of language and text.

    Every language that labels a text enters the model, whatever its share.
    The driver gets one row per language and bucket that occurs: at most
    65,536 per language.
    """
    chosen = (texts.select(F.lower(F.trim(language)).alias("lang"), F.col(text).alias("text"))
              .where("lang is not null and lang <> '' and text is not null")
              .withColumn("hash", F.xxhash64("lang", "text")))
    # copies are one hash; each language is cut into slices by hash, and only slices that can hold
    # its lowest hashes are ranked, so that no text is sorted and no task ranks a whole language
    hashes = chosen.select("lang", "hash").distinct().withColumn("slice", F.shiftright("hash", 52))
    sizes = hashes.groupBy("lang", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("slice").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("before", before).where(F.col("before") < max_rows).select(
        F.col("lang").alias("s_lang"), F.col("slice").alias("s_slice"), "before")
    place = F.row_number().over(Window.partitionBy("lang", "slice").orderBy("hash")) + F.col("before")
    low = (hashes.join(sizes, (F.col("lang") == F.col("s_lang")) & (F.col("slice") == F.col("s_slice")))
           .withColumn("place", place).where(F.col("place") <= max_rows)
           .groupBy("lang").agg(F.max("hash").alias("top")).collect())
    if not low:
        return TextModel((), np.zeros((0, BUCKETS)))
    tops = texts.sparkSession.createDataFrame([(r["lang"], r["top"]) for r in low], "t_lang string, top long")
    sample = (chosen.join(F.broadcast(tops), F.col("lang") == F.col("t_lang")).where("hash <= top")
              .groupBy("lang", "hash").agg(F.first("text").alias("text")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                table = tables.setdefault(name, np.zeros(BUCKETS, np.int64))
                table += np.bincount(trigram_buckets(value.as_py()), minlength=BUCKETS)
        for name, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(table[at])],
                                             names=["lang", "bucket", "n"])

    bounded_batches(texts.sparkSession)
    counts = sample.select("lang", "text").mapInArrow(
        count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(counts["lang"].unique()))
    table = np.full((len(languages), BUCKETS), smoothing)
    for i, name in enumerate(languages):
        mine = counts[counts["lang"] == name]
        table[i, mine["bucket"].to_numpy()] += mine["n"].to_numpy()
    return TextModel(languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


# --- pages ---------------------------------------------------------------

_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)")
_HIDDEN = {n: re.compile(rf"</{n}\b[^>]*>", re.I) for n in ("script", "style", "nav", "noscript", "template")}
_HTML = re.compile(r"""<html(?=[\s/])((?:"[^"]*"|'[^']*'|[^<>])*)""", re.I)
_ATTRIBUTE = re.compile(r"""([^\s=<>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s<>]+))?""")
_PRIMARY = re.compile(r"""["']?\s*([A-Za-z]{2,3})\b""")


def visible_text(page: str | None) -> str:
    """Text outside tags, comments, scripts, styles and navigation, in one pass over the whole page."""
    page, parts, at = page or "", [], 0
    while (lt := page.find("<", at)) >= 0:
        parts.append(page[at:lt])
        if page.startswith("<!--", lt):
            end, width = page.find("-->", lt), 3
        elif page.startswith("<!", lt) or _TAG.match(page, lt):
            end, width = page.find(">", lt), 1
        else:
            parts.append("<")
            at = lt + 1
            continue
        if end < 0:
            at = len(page)
            break
        at = end + width
        name = _TAG.match(page, lt)
        if name and page[lt + 1] != "/" and (closing := _HIDDEN.get(name[1].lower())):
            close = closing.search(page, at)
            at = close.end() if close else len(page)
        parts.append(" ")
    parts.append(page[at:])
    return html_lib.unescape("".join(parts))


def declared_language(page: str | None) -> str | None:
    """Primary subtag of ``<html lang=...>`` in lower case; attributes of other names (``xml:lang``, ``data-lang``) don't count."""
    for tag in _HTML.finditer(page or ""):
        for name, value in _ATTRIBUTE.findall(tag[1]):
            if name.lower() == "lang":
                found = _PRIMARY.match(value)
                return found[1].lower() if found else None
    return None


def address_levels(url: str | None) -> tuple[str | None, str | None, str | None]:
    """Suffix, registered domain (the last two labels) and host of an address; nulls where there is none."""
    try:
        host = (urlsplit(url or "").hostname or "").strip(".").lower()
    except ValueError:
        host = ""
    labels = [x for x in host.split(".") if x]
    if not labels:
        return None, None, None
    return labels[-1], ".".join(labels[-2:]), ".".join(labels)


# --- evidence ------------------------------------------------------------


def page_evidence(pages: DataFrame, model: TextModel, *, key: str = "page_id", url: str = "url",
                  page: str = "html") -> DataFrame:
    """``key, suffix, domain, host, declared, trigrams, logs`` for HTML pages."""
    slim = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(page).alias("page"))

    def one(address, body):
        return (*address_levels(address), declared_language(body), *model.log_likelihoods(visible_text(body)))
    return _evidence(slim, one)


def text_evidence(texts: DataFrame, model: TextModel, keys: list[Column], *, text: str, source: str,
                  declared: str) -> DataFrame:
    """The same for plain texts whose source stands for the host and that declare a language in a column."""
    slim = texts.select(F.struct(*keys).alias("key"), F.struct(
        F.col(source).cast("string").alias("source"), F.lower(F.trim(F.col(declared).cast("string"))).alias("declared"))
        .alias("given"), F.col(text).alias("text"))

    def one(given, body):
        return (None, None, given["source"], given["declared"] or None, *model.log_likelihoods(body))
    return _evidence(slim, one)


def _evidence(slim: DataFrame, one) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(a.as_py(), b.as_py()) for a, b in zip(batch.column(1), batch.column(2))]
            suffix, domain, host, declared, n, logs = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.string()) for x in (suffix, domain, host, declared)),
                 pa.array(n, pa.int64()), pa.array(list(logs), pa.list_(pa.float64()))],
                names=["key", "suffix", "domain", "host", "declared", "trigrams", "logs"])

    bounded_batches(slim.sparkSession)
    kind = slim.schema["key"].dataType.simpleString()
    return slim.mapInArrow(run, f"key {kind}, suffix string, domain string, host string, declared string, "
                                "trigrams long, logs array<double>")


def fuse(evidence: DataFrame, languages: tuple[str, ...], *, strength: float = 5.0, least: float = 0.5) -> DataFrame:
    """Posterior of each row of ``evidence``.

    Returns ``key, lang string, posterior double, text_lang, declared, host
    string, trigrams long``.  ``lang`` is ``und`` where no posterior reaches
    ``least``, where the text has no letters or is in none of the model's
    languages (``trigrams`` negative in ``evidence``; the posterior is 0 then,
    whatever is declared), or where the model knows no language.  Of equal posteriors the first language in order counts.
    """
    if not languages:
        return evidence.select("key", F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("posterior"),
                               F.lit(None).cast("string").alias("text_lang"), "declared", "host", "trigrams")
    shares = [f"p{i}" for i in range(len(languages))]
    known = F.when(F.col("declared").isin(*languages), F.col("declared")).otherwise(
        F.when(F.col("declared").isNotNull(), F.lit("other")))
    total = F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x))
    # rows without text carry no weight in any count
    weight = (F.col("trigrams") > 0).cast("double")
    rows = evidence.withColumn("said", known).withColumn("total", total).withColumn("w", weight)
    for i, p in enumerate(shares):
        rows = rows.withColumn(p, F.col("w") * F.exp(F.col("logs")[i]) / F.col("total"))
    rows = materialised(rows.drop("total"))
    sums = [F.sum(p).alias(p) for p in shares]

    # declarations: at most one row per language, "other" and none
    table = {r["said"]: r for r in rows.groupBy("said").agg(*sums, F.sum("w").alias("w")).collect()}
    count = sum((r["w"] for r in table.values()), 0.0)
    per = [sum((r[p] for r in table.values()), 0.0) for p in shares]
    base = [(x + 1.0) / (count + len(languages)) for x in per]
    said = [r for k, r in table.items() if k is not None]
    spoken = [sum((r[p] for r in said), 0.0) for p in shares]
    heard = sum((r["w"] for r in said), 0.0)
    options = [*languages, "other"]
    likely = {d: [(table[d][p] if d in table else 0.0) for p in shares] for d in options}
    # every value keeps a share of what is heard of it anywhere, so that no declaration rules a language out
    chance = {d: ((table[d]["w"] if d in table else 0.0) + 1.0) / (heard + len(options)) for d in options}
    hints = F.create_map(*[x for d in options for x in (F.lit(d), F.array(*[
        F.lit(math.log((likely[d][i] + strength * chance[d]) / (spoken[i] + strength))) for i in range(len(shares))]))])

    # the chain of priors: sums per host, domain and suffix, brought together per host
    hosts = rows.where("host is not null").groupBy("host", "domain", "suffix").agg(
        F.sum("w").alias("w"), *sums)
    levels = hosts.select(F.col("host").alias("h_host"), F.col("domain").alias("d"), F.col("suffix").alias("s"),
                          F.col("w").alias("host_w"), *[F.col(p).alias(f"host_{p}") for p in shares])
    for level, name in (("domain", "d"), ("suffix", "s")):
        up = hosts.where(F.col(level).isNotNull()).groupBy(F.col(level).alias(f"{level}_name")).agg(
            F.sum("w").alias(f"{level}_w"), *[F.sum(p).alias(f"{level}_{p}") for p in shares])
        levels = levels.join(up, F.col(name) == F.col(f"{level}_name"), "left").drop(f"{level}_name")
    joined = rows.join(levels.drop("d", "s"), F.col("host") == F.col("h_host"), "left")

    scores = []
    for i, p in enumerate(shares):
        prior = F.lit(base[i])
        for level in ("suffix", "domain", "host"):
            own = F.when(F.col(f"{level}_w").isNull(), F.lit(0.0)).otherwise(
                F.greatest(F.col(f"{level}_{p}") - F.col(p), F.lit(0.0)))
            size = F.coalesce(F.greatest(F.col(f"{level}_w") - F.col("w"), F.lit(0.0)), F.lit(0.0))
            prior = (own + F.lit(strength) * prior) / (size + F.lit(strength))
        hint = F.coalesce(F.element_at(hints, F.col("said"))[i], F.lit(0.0))
        scores.append(F.col("logs")[i] + hint + F.ln(prior))
    names = F.array(*[F.lit(x) for x in languages])
    scored = joined.withColumn("scores", F.array(*scores)).withColumn("top", F.array_max("scores"))
    at = F.array_position("scores", F.col("top")).cast("int")
    posterior = 1.0 / F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    found = scored.select("key", F.element_at(names, at).alias("guess"), posterior.alias("posterior"),
                          F.when(F.col("trigrams") > 0, F.element_at(
                              names, F.array_position("logs", F.array_max("logs")).cast("int"))).alias("text_lang"),
                          "declared", "host", "trigrams")
    found = found.withColumn("posterior", F.when(F.col("trigrams") < 0, F.lit(0.0)).otherwise(F.col("posterior")))
    sure = (F.col("posterior") >= least) & (F.col("trigrams") > 0)
    return found.select("key", F.when(sure, F.col("guess")).otherwise(F.lit(UNDETERMINED)).alias("lang"),
                        "posterior", "text_lang", "declared", "host", F.abs("trigrams").alias("trigrams"))


def identify_pages(pages: DataFrame, model: TextModel, *, key: str = "page_id", url: str = "url",
                   page: str = "html") -> DataFrame:
    """Language of every page: ``key, lang, posterior, text_lang, declared, host, trigrams``.

    Null and empty pages and pages without letters are ``und``; a missing or
    broken address leaves the prior of all rows; an unknown or missing
    declaration is no evidence for any one language.  Very long pages are
    read whole.  Repeated rows and null keys give a row each.  An empty table
    gives no rows.  Other columns are ignored, whatever their names.
    """
    return fuse(page_evidence(pages, model, key=key, url=url, page=page), model.languages).withColumnRenamed("key", key)
