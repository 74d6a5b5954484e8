"""URL filters: rules on hosts and paths, and for the rest a character language-model ratio.

Two variable-order Markov models over characters, one of accepted and one of rejected URLs, back off from longer to
shorter contexts with Witten-Bell smoothing. A URL's score is the difference of the two log-likelihoods (rejected
minus accepted), divided by its length; the threshold is calibrated on labelled URLs that the models haven't seen.

The labelled URLs are made from the word lists and templates below, which both classes share, so that names alone
tell them apart. All of the corpus's own hosts, each once whatever its share of the URLs, join the accepted side, as
most hosts are acceptable: their pairs of context and character are counted in the cluster, and all of them make the
model. Up to a bound it is sent to the tasks; past it the counts stay tables, and probabilities are joined to the pairs
that the URLs hold, context by context, with the same result. Hosts are dealt into two halves, each with a model of its own, and a URL is judged by the model
of the half that its host isn't in: no host vouches for itself. The threshold and the accuracy that is reported come
from words that the models haven't seen, all URLs of a word held out together.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import frugal, materialize

#: (verdict, host, path): the longest that fits a URL wins.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
ORDER = 5
#: Pairs of the corpus up to which a model is held in memory, and how often each labelled URL counts against one host.
MAX_PAIRS, LABEL_COUNT = 1 << 17, 4
_PREFIX = re.compile(r"^(www|m|blog)\.")
# Words of acceptable and of unwanted sites' names, and shared templates.
ACCEPTED = "academy archive astronomy atlas biology blog books botany bridge chemistry city college community cooking courses culture docs earth economy education engineering essays farming field forest forum garden geography guide harbor health history home journal kitchen knowledge language law lesson letters library literature magazine maps mathematics medicine mountain museum music nature news notes ocean observatory orchestra painting papers philosophy physics places planet poetry press question recipes report research review river school science sports story studies teacher theatre times today travel tutorial university valley village water weather weekly wiki world writers".split()
REJECTED = "adserver adult affiliate bet bets betting bingo blackjack cams casino cheap click clicks coupon crack credit crypto dating debt discount doubler earn erotic escort fake free freebie gambling hookup hot jackpot keygen lenders loan loans lottery lotto luxury milf money naked nude offers payday pharma phish pills poker popads porn prize promo replica rolex roulette serial sex sexy slots spam spins sweepstakes tablets torrent tracker viagra warez weightloss win winner wins xxx".split()
TEMPLATES = ("https://{a}.example.com/en/{n}", "http://www.{a}-{b}.example.net/de/{n}.html", "https://{a}{b}.example.org/fr/{n}/", "https://m.{a}-{b}.example.com/es/{n}?page=2&ref=x", "http://blog.{a}.example.org/en/{n}#top", "https://{a}-{b}.example.net/{n}?utm_source=feed", "http://www.{a}{b}.com/{b}/{n}", "https://{a}.org/{b}-{a}/{n}.html")


FOLDS = 5


def labelled() -> list[tuple[str, int, int]]:
    """(URL, 1 if it is to be rejected, fold): each word of a list with several others in several templates; a URL's
    words are all of one fold."""
    out = []
    for words, y in ((ACCEPTED, 0), (REJECTED, 1)):
        for i, a in enumerate(words):
            fold = crc32(a.encode()) % FOLDS
            own = [w for w in words if crc32(w.encode()) % FOLDS == fold]
            for j, t in enumerate(TEMPLATES):
                b = own[(i * 7 + j * 11 + 3) % len(own)]
                out.append((t.format(a=a, b=b, n=(i * 131 + j * 977) % 9000 + 100), y, fold))
    return out


def shape(url: str | None) -> str:
    """What the models read: without scheme, in lower case, digits as 0; a null URL is empty."""
    u = (url or "").lower()
    u = u[u.find("://") + 3 :] if "://" in u else u
    return "".join("0" if c.isdigit() else c for c in u)


def pairs(text: str, order: int = ORDER) -> Iterator[tuple[str, str]]:
    """(context, character) for each character and each length of context."""
    padded = "^" * order + text + "$"
    return ((padded[i - k : i], padded[i]) for i in range(order, len(padded)) for k in range(order + 1))


class Markov:
    """Variable-order character model: p(c | context) = (count + types * p(c | shorter)) / (total + types)."""

    def __init__(self, order: int = ORDER):
        self.order, self.seen, self.memo = order, defaultdict(Counter), {}
        self.rest: dict[str, tuple[int, int]] = {}  # counts of characters that seen leaves out, and how many they are

    def learn(self, text: str, times: int = 1) -> None:
        for context, c in pairs(text, self.order):
            self.seen[context][c] += times

    def p(self, context: str, c: str) -> float:
        if (got := self.memo.get((context, c))) is None:
            lower = self.p(context[1:], c) if context else 1 / 256
            n, (more, kinds) = self.seen.get(context) or Counter(), self.rest.get(context, (0, 0))
            kinds += len(n)
            got = (n[c] + kinds * lower) / (n.total() + more + kinds) if kinds else lower
            if len(self.memo) < 1_000_000:
                self.memo[context, c] = got
        return got

    def log_likelihood(self, text: str) -> float:
        padded = "^" * self.order + text + "$"
        return sum(math.log(self.p(padded[i - self.order : i], padded[i])) for i in range(self.order, len(padded)))


Counts = list[tuple[str, str | None, int] | tuple[str, str | None, int, int]]


def models(counts: Counts, order: int = ORDER, without: int | None = None) -> tuple[Markov, Markov]:
    """The accepted and the rejected model, of the labelled URLs (but those of a fold) and the corpus's counts.

    Counts are (context, character, n); (context, None, n, kinds) stands for all of a context's other characters."""
    out = Markov(order), Markov(order)
    for context, c, n, *kinds in counts:
        if c is None:
            out[0].rest[context] = (n, *kinds)
        else:
            out[0].seen[context][c] += n
    for u, y, fold in labelled():
        if fold != without:
            out[y].learn(shape(u), LABEL_COUNT)
    return out


def counted(hosts: list[str], order: int = ORDER) -> Counts:
    return [(*k, n) for k, n in Counter(x for u in hosts for x in pairs(shape(u), order)).items()]


def difference(two: tuple[Markov, Markov], url: str | None) -> float:
    s = shape(url)
    return (two[1].log_likelihood(s) - two[0].log_likelihood(s)) / (len(s) + 1)


def half(host: str) -> int:
    """0 or 1; a host with and without www., m. or blog. before it is in the same half."""
    return crc32(_PREFIX.sub("", host).encode()) % 2


class Ratio:
    """Two models for each half of the hosts, and a threshold; of hosts, or of `counts` by half of hosts already chosen.

    Hosts that the other half, with the labelled URLs, takes for rejected ones are left out, so that unwanted hosts of
    the corpus don't teach the accepted model their names."""

    def __init__(self, hosts: list[str], order: int = ORDER, counts: tuple[Counts, Counts] | None = None):
        if counts is None:
            halves = [[u for u in hosts if half(u) == k] for k in (0, 1)]
            judges = [models(counted(x, order), order) for x in halves]
            counts = tuple(counted([u for u in halves[k] if difference(judges[1 - k], u) <= 0], order) for k in (0, 1))
        scored = []
        for known in counts:
            for fold in range(FOLDS):
                two = models(known, order, fold)
                scored += [(difference(two, u), y) for u, y, f in labelled() if f == fold]
        self.models = tuple(models(known, order) for known in counts)
        scored.sort()
        ones, n = sum(y for _, y in scored), len(scored)
        best, passed, low = (-1.0, 0.0), 0, 0
        for i in range(n - 1):  # accepted below the threshold, rejected above it
            low += 1 - scored[i][1]
            passed += scored[i][1]
            good = low / (n - ones) + 1 - passed / ones
            best = max(best, (good, (scored[i][0] + scored[i + 1][0]) / 2))
        self.threshold = max(best[1], 0.0)
        self.held_out_accuracy = sum((s > self.threshold) == y for s, y in scored) / n

    def score(self, url: str | None) -> float:
        """The difference by the models that haven't learned from the URL's host."""
        return difference(self.models[1 - half(parts(url)[0])], url)


def parts(url: str | None) -> tuple[str, str]:
    """(host with A-Z in lower case, path); both empty for a null URL or one without ://."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    end = min((i for i in map(rest.find, "?#") if i >= cut), default=len(rest))
    return host, rest[cut:end]


def rule_for(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """(verdict, rule as text) of the longest rule that fits; of equally long ones the first."""
    fits = [(len(h) + len(p), -i, v, h + p) for i, (v, h, p) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else None


def pair_counts(hosts: DataFrame, judges=None) -> DataFrame:
    """(half, context, c, n) over hosts (host, half); with judges (a broadcast pair of models) over those they accept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                b = whole.slice(a, 1000)
                for k in (0, 1):
                    took = [u for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if h == k and (judges is None or difference(judges.value[k], u) <= 0)]
                    if took:
                        context, c, n = zip(*counted(took), strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array([k] * len(n), pa.int32()), pa.array(context), pa.array(c), pa.array(n, pa.int64())], names=["half", "context", "c", "n"])

    n = hosts.select("host", "half").mapInArrow(frugal(run), "half int, context string, c string, n long")
    return n.groupBy("half", "context", "c").agg(F.sum("n").alias("n"))


def _collected(counts: DataFrame) -> tuple[Counts, Counts]:
    rows = counts.collect()
    return tuple([(r.context, r.c, r.n) for r in rows if r.half == k] for k in (0, 1))


def threshold(counts: DataFrame) -> float:
    """Ratio's threshold from counts of any size: the labelled URLs need their own pairs' counts only, and of each of
    their contexts the sum and the number of other characters."""
    spark = counts.sparkSession
    mine = {x for u, _, _ in labelled() for x in pairs(shape(u))}
    own = F.broadcast(spark.createDataFrame(sorted(mine), "context string, c string").withColumn("own", F.lit(True)))
    contexts = F.broadcast(spark.createDataFrame(sorted({(x,) for x, _ in mine}), "context string"))
    found = counts.join(contexts, "context").join(own, ["context", "c"], "left")
    rows = found.groupBy("half", "context", F.when(F.col("own"), F.col("c")).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()
    return Ratio([], counts=tuple([(r.context, r.c, r.n, *[r.kinds] * (r.c is None)) for r in rows if r.half == k] for k in (0, 1))).threshold


def differences(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, d): difference() of texts (id, half, s: a shape) by the models of counts, where no model fits in memory.

    Every character of a text is a pair with a context of full length. Of the distinct ones probabilities follow from
    the shortest context to the longest; a key of these joins has as many rows as there are characters, at most."""
    spark = texts.sparkSession
    rejected = spark.sparkContext.broadcast(models([])[1])
    labels = spark.createDataFrame([(x, c, n * LABEL_COUNT) for x, c, n in counted([u for u, y, _ in labelled() if not y])], "context string, c string, n long")
    labels = labels.crossJoin(spark.createDataFrame([(0,), (1,)], "half int"))
    known = materialize(counts.unionByName(labels).groupBy("half", "context", "c").agg(F.sum("n").alias("n")), "pairs")
    totals = materialize(known.groupBy("half", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")), "contexts")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                rows = []
                for i, k, s in zip(*(x.to_pylist() for x in whole.slice(a, 1000).columns), strict=True):
                    padded = "^" * ORDER + s + "$"
                    rows += [(i, k, padded[at - ORDER : at], padded[at]) for at in range(ORDER, len(padded))]
                i, k, context, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(k, pa.int32()), pa.array(context), pa.array(c)], names=["id", "half", "context", "c"])

    def log(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            half, context, c, p = b.columns
            d = [math.log(rejected.value.p(x, y)) - math.log(z) for x, y, z in zip(context.to_pylist(), c.to_pylist(), p.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([half, context, c, pa.array(d, pa.float64())], names=["half", "context", "c", "d"])

    grams = texts.select("id", "half", "s").mapInArrow(frugal(split), "id long, half int, context string, c string")
    key, shorter = ["half", "context", "c"], F.expr("substring(context, 2)")
    wanted = [materialize(grams.select(key).distinct(), "wanted")]
    for _ in range(ORDER):
        wanted.append(materialize(wanted[-1].withColumn("context", shorter).distinct(), "wanted"))
    lower = None
    for x in reversed(wanted):
        x = x.join(totals, key[:2], "left").join(known, key, "left")
        if lower is None:
            x = x.withColumn("lower", F.lit(1 / 256))
        else:
            x = x.withColumn("shorter", shorter).join(lower.select("half", F.col("context").alias("shorter"), "c", F.col("p").alias("lower")), ["half", "shorter", "c"])
        p = F.expr("case when kinds is null then lower else (coalesce(n, 0) + kinds * lower) / (total + kinds) end")
        lower = materialize(x.select(*key, p.alias("p")), "probabilities")
    logs = materialize(lower.mapInArrow(frugal(log), "half int, context string, c string, d double"), "logs")
    return grams.join(logs, key).groupBy("id").agg(F.avg("d").alias("d"))


def _numbered(texts: DataFrame) -> DataFrame:
    return materialize(texts.withColumn("id", F.monotonically_increasing_id()), "texts")


def judge(pages: DataFrame, rules=RULES, most: int = MAX_PAIRS) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of pages.

    score is the calibrated log-likelihood difference (over 0: block), also where a rule decides. A null, empty or
    odd URL has empty parts, fits no rule and is judged by its characters; an empty table gives an empty one. Where a
    half of the hosts has over `most` pairs, models stay tables in the cluster; nothing is left out of them."""
    spark = pages.sparkSession
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("host")
    hosts = pages.select(host).where("host <> ''").distinct()
    hosts = materialize(hosts.withColumn("half", (F.crc32(F.regexp_replace("host", _PREFIX.pattern, "")) % 2).cast("int")), "hosts")
    every = materialize(pair_counts(hosts), "counts")
    shared, small = None, all(r["count"] <= most for r in every.groupBy("half").count().collect())
    if small:
        known = _collected(every)
        judges = spark.sparkContext.broadcast([models(known[1 - k]) for k in (0, 1)])
        shared = spark.sparkContext.broadcast(Ratio([], counts=_collected(pair_counts(hosts, judges))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for url in b.column(1).to_pylist():
                host, path = parts(url)
                found = rule_for(host, path, rules)
                rows.append((host, path, found and found[1], found and found[0], 1 - half(host), shape(url) if shared is None else None, shared and shared.value.score(url) - shared.value.threshold))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = (pa.string(),) * 4 + (pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["page_id", "host", "path", "rule", "verdict", "half", "s", "score"])

    few = pages.select("page_id", "url")
    schema = few.select("page_id").schema
    for c, t in {"host": "string", "path": "string", "rule": "string", "verdict": "string", "half": "integer", "s": "string", "score": "double"}.items():
        schema = schema.add(c, t)
    rows = few.mapInArrow(frugal(run), schema)
    if not small:
        other = _numbered(hosts.select("host", F.col("half").alias("own"), (1 - F.col("half")).alias("half")).mapInArrow(frugal(_shaped), "host string, own int, half int, s string"))
        accepted = other.join(differences(other, every).where("d <= 0"), "id").select("host", F.col("own").alias("half"))
        kept = materialize(pair_counts(accepted), "counts")
        texts = _numbered(rows.select("half", "s").distinct())
        scores = texts.join(differences(texts, kept), "id").select("half", "s", (F.col("d") - threshold(kept)).alias("score"))
        rows = rows.drop("score").join(materialize(scores, "scores"), ["half", "s"])
    verdict = F.coalesce("verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict")
    return rows.select("page_id", "host", "path", "rule", verdict, "score")


def _shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(map(shape, b.column(0).to_pylist())), pa.string())], names=["host", "own", "half", "s"])
