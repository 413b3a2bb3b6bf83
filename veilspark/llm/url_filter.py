"""URL filter: gradient-boosted trees over lexical features, under explicit allow and block rules.

Features of a url's text alone: length, path depth, digit ratio, character entropy, parameter counts, host shape, and
smoothed log-odds of its suffixes (last one and two host labels), of its host's words, found inside runs of letters too,
with the share of the name that words of either side cover, and of its path's words, learned from the labelled urls (for
a training row, from the other half of them). Rules (host and path prefix) come first; the longest that fits decides.

Labelled urls: pass any table of (url, label) to train(); it learns from at most `most_rows` of them, chosen by hash.
The shipped default, seed_urls(), is spelled out from word lists, as the tables carry no url labels.

Cases: a null url, or one without "://", has an empty host and path, fits no rule and is judged by the trees as it
stands; urls of any length are read whole; repeated rows are judged alike; an empty table gives no rows; other columns
are ignored."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.gbt import Boosted

# Words and endings that the seed urls are spelled from.
BAD_WORDS = ["casino", "bets", "bet", "betting", "poker", "slots", "jackpot", "roulette", "pills", "pharma", "viagra", "cialis", "cheap", "free", "win", "spam", "farm", "adult", "xxx", "sex", "porn", "cams", "escort", "ads", "ad", "track", "tracker", "click", "loan", "payday", "crypto", "bonus", "prize", "hot", "deal", "replica", "malware", "warez", "torrent", "keygen"]
GOOD_WORDS = ["news", "blog", "wiki", "forum", "docs", "school", "library", "museum", "city", "health", "science", "garden", "music", "travel", "books", "weather", "river", "market", "history", "kitchen", "sport", "letters", "house", "paper", "field", "bridge", "theory", "people", "report", "data", "bank", "church", "cinema", "coffee", "college", "design", "doctor", "energy", "family", "forest", "hospital", "institute", "journal", "language", "law", "math", "mountain", "ocean", "photo", "physics", "police", "radio", "research", "review", "society", "station", "studio", "summer", "theatre", "university"]
# Ordinary words that hold one of the bad words.
MIXED_WORDS = ["adapter", "address", "admiral", "adventure", "advice", "alphabet", "beethoven", "bread", "breadth", "broad", "canada", "caterpillar", "chapters", "cloanthus", "darwin", "diabetes", "dublin", "essex", "farmer", "farmhouse", "freedom", "freeman", "freelance", "gadget", "hotel", "hothouse", "ideal", "leader", "library", "madrid", "meadow", "methods", "middlesex", "nomad", "ordeal", "pharmacology", "photos", "pillow", "psychotic", "radar", "reader", "readme", "roads", "sextant", "shadow", "shots", "soundtrack", "spammer", "squadron", "sussex", "tibet", "timeslots", "trackside", "tradition", "twins", "window", "windmill", "wine", "winter", "wisconsin"]
SYLLABLES = ["th", "er", "on", "in", "re", "an", "ou", "st", "nd", "ti", "le", "sh", "ver", "ble", "ing", "tion", "ka", "mo", "lu", "pra", "zen", "dor", "fi", "gra", "hel", "jo", "nes", "qui", "sal", "ta", "vi", "wo"]
SEED_SUFFIXES = ["com", "com", "com", "org", "net", "info", "edu", "gov", "io", "co.uk", "ac.uk", "de", "fr", "es", "it", "nl", "ca", "com.au", "co.jp", "example.com", "example.org", "example.net"]
SEED_SUFFIXES_BAD = ["com", "com", "net", "org", "info", "biz", "top", "xyz", "club", "online", "site", "ru", "cc", "co.uk", "de", "example.com", "example.org", "example.net"]
SEED_LANGS = ["en", "de", "fr", "es"]
SEED_TAILS = ["", "", "/", ".html", ".php", "?utm_source=feed", "?page=2&ref=x", "?id=4711", "?q=a+b&lang=en&sort=date", "#top", "#section-2"]

HOST = re.compile(r"://([^/?#]*)([^?#]*)")
FEATURES = ["length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy", "parameters", "query_length", "hyphens", "other_signs", "has_fragment", "longest_label", "suffix_odds", "suffix2_odds", "host_words_most", "host_words_least", "host_share_bad", "host_share_good", "path_words_most"]


def seed_urls(n: int = 6000, seed: int = 7) -> list[tuple[str, int]]:
    """Labelled urls (1: to block), spelled out from the lists above in a fixed order.

    Names of both kinds are run together or hyphenated; a third of the others' names hold a bad word inside an ordinary
    one; paths and tails say nothing about the label but for search terms in some bad paths."""
    rng, out = np.random.default_rng(seed), []
    pick = lambda values: values[int(rng.integers(len(values)))]

    def path() -> str:
        kind, slug = int(rng.integers(6)), "-".join(pick([*GOOD_WORDS, *MIXED_WORDS]) for _ in range(int(rng.integers(1, 6))))
        number = int(rng.integers(10 ** int(rng.integers(1, 7))))
        return ["/", f"/{pick(SEED_LANGS)}/{number}", f"/{int(rng.integers(1999, 2026))}/{int(rng.integers(1, 13)):02d}/{slug}", f"/{pick(GOOD_WORDS)}/{slug}", f"/{pick(GOOD_WORDS)}/{number}", f"/{pick(GOOD_WORDS)}/{pick(GOOD_WORDS)}/{slug}/{number}"][kind]

    for i in range(n):
        bad, glue = i % 3 == 0, pick(["-", "-", "", "."])
        made = "".join(pick(SYLLABLES) for _ in range(int(rng.integers(2, 5))))
        if bad:
            name = glue.join([pick(BAD_WORDS), pick(BAD_WORDS if rng.random() < 0.6 else [*GOOD_WORDS, "x", "24", "365", "best", "online"])])
        elif rng.random() < 0.33:
            name = glue.join([pick(MIXED_WORDS), pick([*GOOD_WORDS, *MIXED_WORDS, made])][: int(rng.integers(1, 3))])
        else:
            name = made if rng.random() < 0.6 else glue.join([pick(GOOD_WORDS), pick([*GOOD_WORDS, made])])
        name = name if rng.random() < 0.8 else pick(["best", "my", "top", "the", made]) + glue + name
        host = pick(["", "", "", "www.", "www.", "blog.", "m.", "shop.", "en."]) + name + "." + pick(SEED_SUFFIXES_BAD if bad else SEED_SUFFIXES)
        out.append((f"{pick(['http', 'https'])}://{host}{path()}{pick(SEED_TAILS)}", int(bad)))
    return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without "://"."""
    m = HOST.search(url or "")
    return (re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def entropy(s: str) -> float:
    if not s:
        return 0.0
    n = np.unique(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)[1] / len(s)
    return float(-(n * np.log2(n)).sum())


def suffixes(host: str) -> tuple[str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


def words(s: str) -> list[str]:
    return [w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", s.lower()) if w]


@dataclass
class UrlModel:
    trees: Boosted = field(default_factory=Boosted)
    odds: dict[str, dict[str, float]] = field(default_factory=dict)
    threshold: float = 0.5
    automaton: object = None

    def inside(self, name: str) -> list[str]:
        """Known host words within a run of letters, from the left, the longest first, apart from each other."""
        import ahocorasick

        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for w in self.odds.get("host", {}):
                if len(w) > 2:
                    self.automaton.add_word(w, w)
            self.automaton.make_automaton()
        longest: dict[int, str] = {}
        for end, w in self.automaton.iter(name) if len(self.automaton) else ():
            begin = end + 1 - len(w)
            if len(w) > len(longest.get(begin, "")):
                longest[begin] = w
        out, free = [], 0
        for begin in sorted(longest):
            if begin >= free:
                out.append(longest[begin])
                free = begin + len(longest[begin])
        return out

    def features(self, urls: list[str | None]) -> np.ndarray:
        out = np.zeros((len(urls), len(FEATURES)))
        known = lambda kind, names, pick=max: pick((v for w in names if (v := self.odds.get(kind, {}).get(w)) is not None), default=0.0)
        for i, url in enumerate(urls):
            url = url or ""
            host, path = split_url(url)
            query = url.partition("?")[2].partition("#")[0]
            one, two = suffixes(host)
            name = host.removesuffix(two) if two != host else host.removesuffix("." + one)
            inner, odds = self.inside(name.lower()), self.odds.get("host", {})
            letters = max(1, sum(map(len, words(name))))
            bad, good = (sum(len(w) for w in inner if sign * odds[w] > 0.5) / letters for sign in (1, -1))
            inner = inner + words(name)
            digits = sum(c.isdigit() for c in url)
            out[i] = (
                len(url), len(host), len(path), path.count("/"), host.count(".") + 1 if host else 0, digits / max(1, len(url)), sum(c.isdigit() for c in host) / max(1, len(host)),
                entropy(url), entropy(host), len([p for p in query.split("&") if p]), len(query), host.count("-"), sum(c in "%_~@!$" for c in url), "#" in url, max(map(len, host.split("."))),
                known("suffix", [one]), known("suffix2", [two]), known("host", inner), known("host", inner, min), bad, good, known("path", words(path)),
            )
        return out

    def fit(self, rows: list[tuple[str | None, int]]) -> UrlModel:
        y = np.array([int(v) for _, v in rows])
        parts = {k: [] for k in ("suffix", "suffix2", "host", "path")}
        for url, _ in rows:
            host, path = split_url(url)
            one, two = suffixes(host)
            name = host.removesuffix(two) if two != host else host.removesuffix("." + one)
            for k, v in (("suffix", [one]), ("suffix2", [two]), ("host", words(name)), ("path", words(path))):
                parts[k].append(set(v))
        x, fold = np.zeros((len(rows), len(FEATURES))), np.arange(len(rows)) % 2
        for f in (0, 1, None):  # odds for the trees come from the other half, then from all rows for what is to come
            use = np.flatnonzero(fold != f)
            self.odds, self.automaton = {k: self._log_odds([sets[i] for i in use], y[use]) for k, sets in parts.items()}, None
            if f is not None:
                own = np.flatnonzero(fold == f)
                x[own] = self.features([rows[i][0] for i in own])
        self.trees.fit(x, y)
        self.automaton = None
        return self

    @staticmethod
    def _log_odds(sets: list[set[str]], y: np.ndarray, smooth: float = 2.0, least: int = 5) -> dict[str, float]:
        count: dict[str, list[int]] = {}
        for names, label in zip(sets, y.tolist(), strict=True):
            for w in names:
                count.setdefault(w, [0, 0])[label] += 1
        bad, good = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
        return {w: float(np.log((b + smooth * bad / len(y)) / (bad + smooth)) - np.log((g + smooth * good / len(y)) / (good + smooth))) for w, (g, b) in sorted(count.items()) if g + b >= least}

    def score(self, urls: list[str | None]) -> np.ndarray:
        return self.trees.predict(self.features(urls))


def train(labelled: DataFrame | None = None, *, url_col: str = "url", label_col: str = "label", most_rows: int = 20_000) -> UrlModel:
    """Learns from labelled urls: at most `most_rows` of the table, by a hash of the url; the seed urls without one."""
    if labelled is None:
        return UrlModel().fit(seed_urls())
    rows = labelled.where(F.col(label_col).isNotNull()).select(F.col(url_col).alias("u"), F.col(label_col).cast("int").alias("y")).orderBy(F.xxhash64("u"), "u", "y").limit(most_rows).collect()
    return UrlModel().fit([(r.u, r.y) for r in rows])


def host_of(url: Column) -> Column:
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (host and path prefix) and its action; null where none fits.

    rules: (action, host, path), such as ("block", "example.org", "/es/")."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def judge_urls(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, url, host, path, rule, score (the trees') and verdict of each row."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(batch.column(1).to_pylist()))], ["id", "url", "score"])

    ids = pages.schema[id_col].dataType.simpleString()
    scored = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).mapInArrow(run, f"id {ids}, url string, score double")
    scored = scored.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, action = rule_columns(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("score") >= model.threshold, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "url", "host", "path", rule.alias("rule"), "score", verdict.alias("verdict"))


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def query(spark, sf_dir: str) -> DataFrame:
    from veilspark.llm.shared import table

    judged = judge_urls(table(spark, sf_dir, "pages"), train(), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")
