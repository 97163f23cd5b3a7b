"""URL filter: host words by unigram Viterbi, multinomial naive Bayes over host and path tokens, and rules.

A host's labels are cut at everything but letters and digits, and each run of letters is split into the
most probable words under a unigram model. Its words are those of the labelled URLs and of a public
tokenizer's vocabulary (``VOCABULARY``, a parameter; None does without), whose ranks give frequencies by
Zipf's law; of its shortest words only those of ``SHORT`` count, as the others are mostly pieces of words. A
word that isn't known gets a probability that falls tenfold with each letter, whatever its length. The table
has a fixed size: nothing is counted over the pages, and each page is judged by itself.

The tables hold no labelled URLs. Naive Bayes, with add-one smoothing and a share ``PRIOR`` of blocked URLs, is
trained on URLs made by ``labelled_urls``: words of one topic in host and path, mixed with words that URLs of
all kinds have. Topics name what is blocked or allowed, not sites; words that both kinds of sites use are in
topics of both. Tokens it hasn't seen don't count. A tie allows. A rule names a host suffix and the start of a
path; the longest rule that fits a URL decides before the classifier.

A null URL, or one without ``://``, has an empty host and path. Repeated rows repeat, extra columns aren't
read, an empty table gives no rows.
"""

from __future__ import annotations

import base64
import math
import random
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read

BLOCKED = """
casino casinos slots slot roulette jackpot poker blackjack baccarat bingo bet bets betting bookmaker wager odds gambling gamble vegas spins lottery win winner winnings lucky bonus
pills pill viagra cialis pharmacy tramadol xanax steroids potency enlargement slimming detox weight loss miracle cure cheap discount generic prescription order
adult porn porno xxx sex sexy nude naked escort escorts cam cams webcam erotic fetish hookup dating girls strip hot mature amateur x
spam backlinks backlink seo link links farm traffic bulk mailer followers likes clicks bot bots autopost cloak doorway
ads ad adserver advert adverts banner banners popup popups tracker tracking track pixel pixels affiliate affiliates click sponsored redirect offer offers promo
payday loan loans cash quick instant money rich earn profit forex crypto bitcoin doubler guaranteed investment income scheme debt
warez crack cracks cracked keygen serial torrent torrents nulled malware virus exe hack hacks cheats exploit free download downloads unlock
phish phishing verify account suspended scam scams fake replica replicas counterfeit rolex claim prize gift giveaway urgent winner free survey
"""
ALLOWED = """
news daily times post herald journal world politics opinion weather report press today local city
science physics chemistry biology research institute laboratory university college academy papers study astronomy stars
library books book novel poetry literature history archive museum art gallery exhibition culture heritage
health hospital clinic medicine doctor nurse patients heart care pill pharmacy drug trial diet weight nutrition therapist
garden plants flowers farm farmers farming forest nature park wildlife birds river sea island ocean
cooking recipes food kitchen bread soup wine winery coffee tea restaurant menu hot cheap eats
travel tourism hotel hotels flights cheap discount tours trips mountains beach map guide express transport railway
school teachers students lessons course courses language grammar math children parents family girls boys education
software code developers docs api reference open source project projects data download downloads free account verify tutorial link links
sports football chess bicycle running club league season results team win winner match track race
music film movies cinema theatre photo camera video festival band song piano
government council county services public law court election tax parliament police safety
business economics market markets trade bank credit loan loans money saving savings investment finance insurance jobs careers company offer offers
community forum blog wiki help support charity church volunteers events gift donate survey
games puzzle toys craft knitting sewing pets dogs cats horses fashion clothes home house design architecture
engineering bridges energy climate water traffic cars electric bot robots machines technology
"""
#: Words that URLs of all kinds have.
COMMON = "www m blog shop web site online page pages index html php article articles post category tag en de fr es id item view about contact my the best top new all for and of to in on my get buy your".split()
#: Words of up to three letters that split runs of letters.
SHORT = frozenset(
    "a i an as at be by do go he if in is it me my no of on or so to up us we all and any are art bad bar bed bet big bit box boy bus buy can car cat cup cut day dog eat end eye far fit for fun get gym "
    "hot how ice job key kid law low man map men net new not now off old one our out own pay pet pub red run sea see sex sky sun tax tea the toy try two van war way web who why win you zoo".split()
)
#: (host suffix, start of path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Share of blocked URLs, URLs made of each kind, how often a trained word counts as the vocabulary's most frequent one does.
PRIOR, URLS, KNOWN = 0.2, 6000, 0.2
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_token = re.compile(r"[a-z]+|[0-9]+")


def host(url: Column) -> Column:
    h = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(h, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host_col: Column, path_col: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # a longer one overrules a shorter
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def labelled_urls(seed: int = 5, urls: int = URLS) -> dict[str, list[list[str]]]:
    """The tokens of made URLs of both kinds: the training set."""
    r, out = random.Random(seed), {}
    for verdict, text in (("block", BLOCKED), ("allow", ALLOWED)):
        topics = [line.split() for line in text.split("\n") if line]
        out[verdict] = []
        for k in range(urls):
            topic = topics[k % len(topics)]
            own = r.choices(topic, k=r.randint(1, 3)) + (r.choices(topic, k=r.randint(0, 2)) if r.random() < 0.6 else [])
            out[verdict].append(own + r.choices(COMMON, k=r.randint(1, 4)))
    return out


def frequencies(vocabulary: str | None = VOCABULARY) -> dict[str, float]:
    """Weights of words: those of a vocabulary in rank order by Zipf's law, and the words of the labelled URLs."""
    out: dict[str, float] = {}
    if vocabulary:
        with open(vocabulary, "rb") as f:
            words = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
        rank = 0
        for w in words:
            if w[:1] == b" " and w[1:].isalpha() and w.isascii():
                w = w[1:].decode().lower()
                if len(w) > 3 or w in SHORT:
                    rank += 1
                    out.setdefault(w, 1 / rank)
    for w in {*SHORT, *COMMON, *BLOCKED.split(), *ALLOWED.split()}:
        out[w] = max(out.get(w, 0.0), KNOWN / 100)
    return out


class Unigrams:
    """Splits a run of letters into the most probable words."""

    def __init__(self, weights: dict[str, float]):
        total = sum(weights.values()) or 1.0
        self.logp = {w: math.log(c / total) for w, c in weights.items()}
        self.unknown, self.longest = min(self.logp.values(), default=0.0) - 2 * math.log(10), max(map(len, weights), default=1)

    def split(self, run: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        # an unknown word from the best place to cut so far: its logarithm falls by the same amount with each letter
        fall, start_score, start_at = math.log(10), 0.0, 0
        for end in range(1, len(run) + 1):
            if best[-1][0] + fall * (end - 1) > start_score + 1e-9:
                start_score, start_at = best[-1][0] + fall * (end - 1), end - 1
            options = [(best[start][0] + self.logp[w], start) for start in range(max(0, end - self.longest), end) if (w := run[start:end]) in self.logp]
            options.append((start_score - fall * (end - 1) + self.unknown, start_at))
            best.append(max(options))
        out, end = [], len(run)
        while end:
            out.append(run[best[end][1] : end])
            end = best[end][1]
        return out[::-1]


class Judge:
    """Naive Bayes over the tokens of host and path."""

    def __init__(self, weights: dict[str, float], labelled: dict[str, list[list[str]]] | None = None, prior: float = PRIOR):
        labelled = labelled or labelled_urls()
        self.words = Unigrams(weights)
        vocabulary = {t for urls in labelled.values() for tokens in urls for t in tokens}
        n = {v: dict.fromkeys(vocabulary, 1) for v in labelled}
        for v, urls in labelled.items():
            for tokens in urls:
                for t in tokens:
                    n[v][t] += 1
        totals = {v: sum(c.values()) for v, c in n.items()}
        self.odds = {w: math.log(n["block"][w] / totals["block"]) - math.log(n["allow"][w] / totals["allow"]) for w in vocabulary}
        self.prior = math.log(prior / (1 - prior))
        self.of_host = lru_cache(100_000)(self._of_host)

    def _of_host(self, host: str) -> tuple[tuple[str, ...], float]:
        tokens = tuple(t for run in _token.findall(host) for t in (self.words.split(run) if run.isalpha() else (run,)))
        return tokens, sum(self.odds.get(t, 0.0) for t in tokens)

    def judge(self, host: str, path: str) -> tuple[tuple[str, ...], float]:
        """(host words, log odds of block)."""
        words, odds = self.of_host(host)
        return words, self.prior + odds + sum(self.odds.get(t, 0.0) for t in _token.findall(path.lower()))


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", vocabulary: str | None = VOCABULARY) -> DataFrame:
    """(page_id, host, path, rule, verdict, host_words, block_odds), a row a page."""
    src = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    shared = pages.sparkSession.sparkContext.broadcast(frequencies(vocabulary))

    def judged(batches):
        judge = Judge(shared.value)
        for batch in batches:
            got = [judge.judge(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([list(w) for w, _ in got], pa.list_(pa.string())), pa.array([o for _, o in got], pa.float64())],
                ["page_id", "host", "path", "host_words", "block_odds"],
            )

    out = src.mapInArrow(judged, T.StructType([*src.schema, T.StructField("host_words", T.ArrayType(T.StringType())), T.StructField("block_odds", T.DoubleType())]))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("block_odds") > 0, "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "host_words", "block_odds")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages")).drop("host_words")


def llm_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host, path, rule, ruled): the part of ``op8_url_filter`` that SQL can say."""
    url = F.col("url")
    src = read(spark, sf_dir, "pages").select("page_id", host(url).alias("host"), path(url).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"))
    return src.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))


LLM_URL_RULES_SQL = r"""
WITH r(suffix, start, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_replace(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '^$', '') AS path FROM u),
f AS (SELECT page_id, suffix || start AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(suffix || start) DESC) AS k
      FROM p JOIN r ON (host = suffix OR ends_with(host, '.' || suffix)) AND starts_with(path, start))
SELECT p.page_id, host, path, rule, verdict AS ruled FROM p LEFT JOIN f ON p.page_id = f.page_id AND k = 1
"""
