"""Operator 7: URL filter: host and path rules, then logistic regression on hashed character n-grams.

Method: the n-grams of host and path (each marked with its part and bounds) fall
into ``BUCKETS`` buckets by XXH64; a logistic regression on which buckets are hit,
trained on a small labelled table of URLs, gives the probability of a URL to be
unwanted. Rules come first: the longest that fits decides.

The fit runs on the driver over the labelled table alone; its weights come back as
one literal. Rows see DataFrame functions only: no join, no shuffle, no state.

Defined cases: null, empty URLs and those without ``://`` have empty host and path,
fit no rule and get the model's verdict on no n-grams; letters beyond A-Z keep
their case; URLs of any length are read whole; repeated rows are judged alike;
other columns stay behind; an empty table gives no rows.
"""

from __future__ import annotations

import math
import string

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources import table

#: Verdict and prefix of the production rules: a host, of which all subdomains count, and the start of a path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

#: Small labelled table, fixed values: unwanted URLs (some with paths like any other's), then wanted ones.
UNWANTED = """
http://casino-bonus.example/free-spins/win
https://www.best-casino.example/poker/jackpot
http://slots.jackpot.example/online-casino
https://bet365-odds.example/betting/free-bet
http://xxx-videos.example/adult/porn
https://free-porn.example/sex/cams
http://hot-adult-cams.example/live-sex
https://cheap-viagra.example/pharmacy/buy
http://online-pharmacy.example/cialis/discount
https://pills-discount.example/viagra-cheap
http://ads.tracker.example/click?id=9
https://adserver.example/banner/popup
http://track.affiliate.example/redirect/click
https://doubleclick-ads.example/adclick/banner
http://win-free-iphone.example/prize/claim
https://prize-winner.example/claim-now/survey
http://get-rich-fast.example/crypto/profit
https://crypto-profit.example/invest/double
http://torrent-crack.example/keygen/download
https://warez-download.example/serial/crack
http://free-download-crack.example/patch
https://login-verify-account.example/secure/update
http://paypal-secure-login.example/verify/password
https://seo-backlinks.example/buy-links/cheap
http://essay-writing-cheap.example/buy-essay
https://replica-watches.example/cheap/rolex
http://payday-loan.example/instant-cash/apply
https://instant-loans.example/payday/cash
http://mega-casino.example/slots/free-spins
https://poker-bonus.example/casino/win-jackpot
http://adult-videos.example/xxx/free
https://sex-cams-live.example/porn/adult
http://cheap-pills.example/online-pharmacy/buy-viagra
https://cialis-online.example/buy-cheap
http://popup-ads.example/banner/click
https://click-tracker.example/ads/redirect
http://claim-your-prize.example/win-iphone
https://free-prize.example/winner/survey
http://bitcoin-profit.example/get-rich/invest
https://cracked-software.example/keygen/crack
http://secure-verify-login.example/account/password
https://update-account.example/paypal-login/verify
http://cheap-backlinks.example/seo/buy-links
https://cheap-replica.example/buy/watches
http://instant-payday.example/loans/cash
https://free-betting.example/odds/bet
https://www.casino-royal.example.org/en/88
http://blog.spam-links.example.net/de/417
https://m.spam-pages.example.org/fr/9031
http://link-farm.example.net/es/44
https://www.content-farm.example.org/en/203
http://m.adult-club.example.net/de/881
https://adult-pics.example.org/fr/301.html
http://www.ads-server.example.net/es/7
https://track-ads.example.org/en/999
http://blog.tracker-ads.example.net/de/12/
https://win-casino.example.net/fr/55
http://m.x-cams.example.org/es/620.html
https://www.poker-win.example.net/en/31/
http://pills-shop.example.org/de/290
https://m.free-spam.example.net/en/5
http://spam-town.example/de/8
https://spam-site.example/page/91
http://spam-host.example/story/18
https://spam-network.example/read/4
http://m.spam.example/chapter/64
https://spam.example/article/9
""".split()
WANTED = """
https://en.encyclopedia.example/article/history
https://docs.library.example/manual/index.html
http://www.university.example/research/papers
https://news.daily.example/world/2021/report
https://blog.gardener.example/posts/roses
http://museum.example/exhibitions/archive
https://www.weather.example/forecast/today
https://forum.cooking.example/thread/bread
http://journal.physics.example/articles/volume-3
https://www.city-council.example/services/libraries
https://wiki.software.example/guide/install
https://school.example/courses/mathematics
http://recipes.example/soup/onion.html
https://travel.notes.example/norway/fjords
https://www.hospital.example/health/advice
https://history.example/medieval/castles
http://poetry.example/collection/spring
https://stories.example/en/chapter/12
https://m.reader.example/de/kapitel/4
https://blog.painter.example/fr/atelier
https://www.gazette.example/es/noticias
http://science.example/en/825
https://www.morning-paper.example.org/en/88
http://blog.theatre-notes.example.net/de/417
https://m.mountain-pages.example.org/fr/9031
http://stone-bridge.example.net/es/44
https://www.thimble-craft.example.org/en/203
http://m.station-clock.example.net/de/881
https://weather-pics.example.org/fr/301.html
http://www.harbour-ferry.example.net/es/7
https://then-and-now.example.org/en/999
http://blog.thrush-songs.example.net/de/12/
https://window-box.example.net/fr/55
http://m.theory-club.example.org/es/620.html
https://www.notation.example.net/en/31/
http://blog.tilting-mill.example.org/de/290
https://thistle-hill.example.net/en/5
http://blog.attention.example.net/en/561
https://www.thread-works.example.org/es/249.html
https://m.reading-room.example.org/en/41
http://www.field-notes.example.net/de/182/
https://therapy-garden.example.net/en/770
http://m.thorn-hill.example.org/fr/489
https://blog.thatcher-school.example.net/es/978
http://www.shore-walks.example.org/en/654
https://reading-room.example/en/essay/41
https://field-notes.example/de/notiz/18
https://archive.choir.example/fr/partition
https://garden-club.example/es/guia/riego
http://village-paper.example/2019/council
https://www.library.example/history/books
https://encyclopedia.example/wiki/physics
http://news.example/2021/world/weather
https://blog.travel.example/posts/norway
http://docs.software.example/guide/manual
https://journal.history.example/articles/archive
http://www.university.example/courses/research
https://forum.gardener.example/thread/roses
http://cooking.example/recipes/bread.html
https://m.stories.example/en/12
https://museum.art.example/collection/archive
http://school.example/guide/mathematics
https://council.example/services/health
http://reports.weather.example/forecast/archive
https://notes.reader.example/fr/chapter/3
http://www.daily.example/news/report
""".split()

SIZES = (2, 3, 4)
BUCKETS = 4096
ROUNDS, RATE, DECAY = 300, 0.5, 0.002


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    return lowered(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def grams(host: str, path: str) -> set[int]:
    """Buckets hit, as ``buckets`` finds them."""
    found = set()
    for part, text in (("h", f"^{host}$" if host else ""), ("p", f"^{path}$" if path else "")):
        for n in SIZES:
            found |= {xxhash.xxh64_intdigest((part + text[i : i + n]).encode(), 42) for i in range(len(text) - n + 1)}
    return {(h - (1 << 64) if h >> 63 else h) % BUCKETS for h in found}


def buckets(host: Column, path: Column) -> Column:
    def of(part: str, text: Column, n: int) -> Column:
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        last = F.when(text == "", 0).otherwise(F.length(marked) - (n - 1))
        places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.pmod(F.xxhash64(F.concat(F.lit(part), F.substring(marked, i, F.lit(n)))), F.lit(BUCKETS)).cast("int"))

    every = [of(part, text, n) for part, text in (("h", host), ("p", path)) for n in SIZES]
    return F.array_distinct(F.concat(*every))


def split(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    path = rest[cut:].partition("?")[0].partition("#")[0]
    return rest[:cut].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), path


def train(unwanted: list[str], wanted: list[str]) -> tuple[float, list[float]]:
    """Bias and weights, by gradient descent; a URL's n-grams share its weight of 1."""
    rows = [(sorted(grams(*split(u))), y) for y, urls in ((1.0, unwanted), (0.0, wanted)) for u in urls]
    bias, weights = 0.0, [0.0] * BUCKETS
    used = sorted({g for found, _ in rows for g in found})
    for _ in range(ROUNDS):
        slope = dict.fromkeys(used, 0.0)
        up = 0.0
        for found, y in rows:
            wrong = probability(found, bias, weights) - y
            up += wrong
            for g in found:
                slope[g] += wrong / math.sqrt(len(found))
        bias -= RATE * up / len(rows)
        for g in used:
            weights[g] -= RATE * (slope[g] / len(rows) * 10 + DECAY * weights[g])
    return round(bias, 6), [round(w, 6) for w in weights]


def probability(found: list[int], bias: float, weights: list[float]) -> float:
    odds = bias + (sum(weights[g] for g in found) / math.sqrt(len(found)) if found else 0.0)
    return 1 / (1 + math.exp(-odds))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def judge(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: tuple[tuple[str, str], ...] = RULES,
    unwanted: list[str] = UNWANTED,
    wanted: list[str] = WANTED,
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``unwanted`` (the model's probability) of each row."""
    bias, weights = train(unwanted, wanted)
    host, path = parts(F.col(url_col))
    df = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    table_ = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<double>")
    df = df.withColumn("hit", buckets(F.col("host"), F.col("path")))
    total = F.aggregate("hit", F.lit(0.0), lambda a, g: a + F.get(table_, g))
    odds = F.lit(bias) + total / F.sqrt(F.greatest(F.size("hit"), F.lit(1)))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    df = df.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), (1 / (1 + F.exp(-odds))).alias("unwanted"))
    model = F.when(F.col("unwanted") > 0.5, "block").otherwise("allow")
    return df.select("page_id", "host", "path", "rule", F.coalesce("ruled", model).alias("verdict"), "unwanted")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


QUERIES = {"op7_urls": op7_urls}
ORACLE: dict[str, str] = {}
