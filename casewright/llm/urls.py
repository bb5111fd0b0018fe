"""URL filters: site rules, and logistic regression on hashed character n-grams.

Host and path of a URL become character 3-grams, hashed into ``buckets`` with a
mark for the part they come from. A logistic regression on which buckets a URL
has gives the probability that the page is unwanted: a bucket that the labels
don't hold counts nothing, so known parts of a long URL aren't thinned out by
unknown ones. It is fitted by gradient descent on the driver to a small labelled
table of URLs, whose n-grams are made by the very same column expressions; the
table is bounded by ``MAX_LABELLED``. Judging is one projection: the weights are a literal array.

A quarter of the labelled table, by the checksum of the URL, is only for
``held_out_report``. Length of n-grams and ridge were chosen by cross-validation on the other rows.

A rule (host, path) fits its host and all subdomains if the URL's path starts
with the rule's; the longest rule wins, host before path, and overrides the
regression.

Defined results: a null URL or one without ``://`` has empty host and path and
is judged on those; repeated rows are judged one by one; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LABELLED = 5_000

#: The rules of the production query.
BLOCK, ALLOW = "block", "allow"
RULES = (("net", "/", BLOCK), ("example.net", "/en/", ALLOW), ("example.com", "/de/", BLOCK), ("org", "/fr/", ALLOW))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z folded."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_hits(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The winning rule as ``host`` + ``path``, and its verdict; null if none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]), -len(r[1])))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for site, prefix, said in reversed(ordered):
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(prefix)
        name = F.when(fits, F.lit(site + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def ngrams(host: Column, path: Column, buckets: int, size: int = 3) -> Column:
    """Distinct buckets of all character n-grams of host and path, each part between marks."""

    def grams(text: Column, part: str) -> Column:
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        places = F.sequence(F.lit(1), F.greatest(F.length(marked) - (size - 1), F.lit(1)))
        return F.transform(places, lambda k: F.pmod(F.xxhash64(F.lit(part), F.substring(marked, k, F.lit(size))), F.lit(buckets)).cast("int"))

    return F.array_distinct(F.concat(grams(host, "h"), grams(path, "p")))


#: The small labelled table that the production query is fitted to, one host and path a line.
UNWANTED = """
www.casino-royal-bonus.top/free-spins/register.html
bestonlinecasino24.win/slots/jackpot?aff=77
poker-vip-club.bet/deposit-bonus-200
livebet-sports.win/odds/today
mega-jackpot-slots.club/play-now
cheap-viagra-online.pharmacy-rx.biz/order
canadian-pills-discount.biz/cialis/buy-cheap
www.buy-tramadol-no-prescription.info/checkout
weightloss-miracle-pills.shop/special-offer
keto-gummies-reviews.click/buy-2-get-1
hot-singles-tonight.date/chat/free-signup
xxx-tube-videos.porn/watch/8812
free-adult-cams.live/room/anna
sexy-girls-dating.club/join
adultfriend-hookup.top/?click=9
replica-watches-outlet.shop/rolex-cheap
www.louis-bags-outlet-sale.top/clearance
designer-shoes-discount.store/90-off
payday-loans-instant.loan/apply-now
bad-credit-loan-approved.biz/fast-cash
make-money-fast-online.win/secret-method
earn-5000-daily.click/crypto-robot
bitcoin-doubler-x2.top/invest
crypto-giveaway-elon.live/claim
double-your-btc.win/deposit
free-iphone-winner.click/claim-prize
www.survey-prize-center.top/winner/confirm
you-won-giftcard.win/claim.php?id=1
secure-login-verify-account.tk/paypal/signin.php
appleid-verify-support.ml/login/update.php
bank-account-alert.cf/secure/confirm.html
update-your-password.ga/webscr/login.php
netflix-billing-problem.top/signin/update
download-crack-keygen.cc/photoshop-full-version
warez-free-downloads.to/cracked-games
full-movie-torrent-hd.cc/free-download
serial-keys-generator.cc/windows-activator
free-mp3-downloads-now.top/track/hit
spam-link-farm.biz/links/page77.html
seo-backlinks-cheap.click/buy-1000-links
buy-followers-cheap.shop/instagram-likes
traffic-exchange-bot.top/redirect.php?url=7
click-track-affiliate.click/go.php?aff=12
promo-redirect.top/out.php?to=offer
best-deals-coupon-codes.click/promo/50-off
limited-time-offer.shop/buy-now
work-from-home-jobs-easy.biz/signup-bonus
online-gambling-tips.bet/sure-win
sports-betting-free-picks.bet/vip
lottery-winner-numbers.win/claim
forex-signals-profit.biz/join-vip
miracle-hair-growth.shop/order-now
male-enhancement-pills.top/trial
diet-pills-that-work.club/free-trial
escort-girls-city.date/gallery
nude-celebs-leaked.porn/pics
anime-hentai-xxx.porn/watch
essay-writing-service-cheap.biz/order
fake-diploma-buy.shop/degree
fake-id-cards.top/order-now
cheap-cigarettes-online.biz/buy
vape-wholesale-discount.shop/sale
unlock-phone-free-crack.cc/imei
hacked-games-mod-apk.cc/download-free
free-robux-generator.win/verify
vbucks-generator-free.top/human-verification
whatsapp-spy-hack.cc/download
hack-facebook-password.tk/tool
antivirus-warning-alert.tk/scan-now.exe
your-pc-is-infected.ml/call-support
free-spins-bonus.blogspot.com/2021/05/
www.cheap-meds-online.wordpress.com/en/
pills-discount.weebly.com/page/12
m.online-bets.tripod.com/77
sportbets-free.blogspot.com/en/5.html
ads-server.weebly.com/track
adtracker.wordpress.com/click/33
track-ads.webs.com/en/201
spamlinks.tripod.com/fr/8
link-farm-network.webs.com/de/40
casino-tips.blogspot.com/es/3
poker-bonus.webs.com/index.html
warez-archive.tripod.com/files/9
torrent-cracks.weebly.com/en/64
xxx-pictures.webs.com/fr/2
sex-cams.blogspot.com/en/19
payday-loan.wordpress.com/2019/11/
win-prizes.weebly.com/en/71
phishing-mail.tripod.com/login
malware-downloads.webs.com/en/5
"""
ORDINARY = """
en.wikipedia.org/wiki/History_of_astronomy
de.wikipedia.org/wiki/Bibliothek
fr.wikipedia.org/wiki/Universit%C3%A9
www.gutenberg.org/ebooks/1342
docs.python.org/3/library/itertools.html
spark.apache.org/docs/latest/sql-programming-guide.html
www.nasa.gov/missions/science-news/
www.nature.com/articles/s41586-020-2649-2
arxiv.org/abs/1706.03762
www.who.int/news-room/fact-sheets
europa.eu/about/history_en
www.bbc.co.uk/news/science-environment
www.lemonde.fr/culture/article/2021/03/02/exposition.html
www.zeit.de/wissen/2020-11/klima-forschung
elpais.com/cultura/2022/05/museo.html
www.nps.gov/yell/planyourvisit/index.htm
museum.artcity.org/collections/paintings/101
library.university.edu/catalog/search
cs.university.edu/courses/algorithms/lecture3.pdf
www.city-council.gov/services/waste
weather.gov/forecast/region/north
www.school-district.org/calendar/2023
blog.gardenerworld.com/growing-tomatoes
www.cookbook.com/recipes/apple-pie
recipes.kitchenstories.net/bread/sourdough
travelguide.com/europe/portugal/lisbon
hiking-trails.org/alps/route-12
www.musicreview.com/albums/2019/jazz
forum.linuxusers.org/thread/48213
stackoverflow.com/questions/11227809
github.com/apache/arrow/blob/main/README.md
www.oldbooks.net/authors/austen
history.museum.ca/exhibits/viking-ships
www.birdwatching.org/species/heron
astronomy-club.net/observations/saturn
news.localpaper.com/2021/06/council-meeting
www.dailyreport.net/world/article-55123
radio.station.fm/programme/morning
sports.weekly.com/football/report
www.railway-society.org/timetables/1950
www.biology-lab.edu/people/research
chess.club.org/games/archive
www.parliament.uk/business/publications
open-data.gov/dataset/population
maps.survey.gov/sheets/42
www.painting-school.fr/cours/aquarelle
www.stadtbibliothek.de/service/oeffnungszeiten
www.rathaus.de/buerger/formulare
www.ayuntamiento.es/servicios/cultura
www.biblioteca.es/libros/novela
www.mairie.fr/vie-locale/associations
journal.physics.org/volume12/issue3
www.theatre.org/season/hamlet
film-archive.org/silent/1925
www.farm-museum.org/visit
www.lighthouse-keepers.org/history
www.knitting-patterns.net/scarf
www.bicycle-repair.com/guide/brakes
www.photo-journal.com/landscape/2020
shop.bookstore.com/fiction/new
www.teacher-resources.org/maths/fractions
www.health.gov/vaccines/schedule
www.hospital.org/departments/cardiology
www.language-school.com/courses/spanish
www.startup-news.com/interview/founder
dev.blog.org/posts/2022/unit-testing
wiki.openstreetmap.org/wiki/Map_features
community.garden.org/events
www.volunteer-firefighters.org/training
podcasts.public-radio.org/episode/214
gardening-notes.blogspot.com/2021/05/
our-school-trip.wordpress.com/en/
history-of-bridges.weebly.com/page/12
m.village-choir.tripod.com/77
mountain-walks.blogspot.com/en/5.html
star-charts.weebly.com/maps
bread-and-cheese.wordpress.com/recipes/33
river-fishing.webs.com/en/201
poesie-et-chansons.tripod.com/fr/8
wandern-im-harz.webs.com/de/40
cuentos-cortos.blogspot.com/es/3
old-trains.webs.com/index.html
stamp-collectors.tripod.com/lists/9
watercolour-class.weebly.com/en/64
carnets-de-voyage.webs.com/fr/2
kitchen-garden.blogspot.com/en/19
family-tree.wordpress.com/2019/11/
chemistry-notes.weebly.com/en/71
choir-practice.tripod.com/calendar
science-fair.webs.com/en/5
"""


def default_labels() -> list[tuple[str, bool]]:
    """The labelled table: (url, unwanted)."""
    return [(f"http://{line}", unwanted) for lines, unwanted in ((UNWANTED, True), (ORDINARY, False)) for line in lines.split()]


def fit(spark: SparkSession, labels: Iterable[tuple[str, bool]], buckets: int = 4096, rounds: int = 1500, rate: float = 0.05, ridge: float = 1e-3) -> list[float]:
    """Weights by bucket, then the bias. The labelled rows are bounded, so gradient descent runs on the driver."""
    rows = list(labels)
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled URLs")
    frame = spark.createDataFrame([(u, bool(y)) for u, y in rows], "url string, y boolean").coalesce(1)
    found = frame.select(ngrams(host(F.col("url")), path(F.col("url")), buckets).alias("g"), "y").collect()
    x, y = np.zeros((len(found), buckets)), np.array([float(r.y) for r in found])
    for k, r in enumerate(found):
        x[k, r.g] = 1.0
    weights, bias = np.zeros(buckets), 0.0
    for _ in range(rounds):
        miss = (1.0 / (1.0 + np.exp(-np.clip(bias + x @ weights, -30.0, 30.0))) - y) / max(len(y), 1)
        weights -= rate * (x.T @ miss + ridge * weights)
        bias -= rate * float(miss.sum())
    return [*weights.tolist(), bias]


def is_held_out(url: str) -> bool:
    """Whether a labelled URL is kept from fitting in ``held_out_report``."""
    return zlib.crc32(url.encode()) % 4 == 0


def held_out_report(spark: SparkSession, labels: Iterable[tuple[str, bool]] | None = None, threshold: float = 0.5) -> dict[str, int]:
    """Counts of right and wrong verdicts on the held-out quarter of the labels, by a model that is fitted to the rest."""
    rows = default_labels() if labels is None else list(labels)
    model = fit(spark, [r for r in rows if not is_held_out(r[0])])
    frame = spark.createDataFrame([r for r in rows if is_held_out(r[0])], "url string, y boolean")
    blocked = probability(host(F.col("url")), path(F.col("url")), model) >= threshold
    tally = frame.select("y", blocked.alias("b")).groupBy("y", "b").count().collect()
    names = {(True, True): "blocked_unwanted", (True, False): "allowed_unwanted", (False, True): "blocked_ordinary", (False, False): "allowed_ordinary"}
    return dict.fromkeys(names.values(), 0) | {names[r.y, r.b]: r["count"] for r in tally}


def probability(host: Column, path: Column, model: list[float]) -> Column:
    """Probability that a URL is unwanted, from its n-grams and the model's weights."""
    buckets = len(model) - 1
    weights = F.array(*(F.lit(w) for w in model[:-1]))
    grams = ngrams(host, path, buckets)
    total = F.aggregate(grams, F.lit(0.0), lambda acc, b: acc + F.element_at(weights, b + 1))
    return 1.0 / (1.0 + F.exp(-(F.lit(model[-1]) + total)))


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, labels: Iterable[tuple[str, bool]] | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the regression's probability of every page."""
    model = fit(pages.sparkSession, default_labels() if labels is None else labels)
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host(F.col("url").cast("string")).alias("host"), path(F.col("url").cast("string")).alias("path"))
    scored = parts.withColumn("p_unwanted", probability(F.col("host"), F.col("path"), model))
    name, verdict = rule_hits(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("p_unwanted") >= threshold, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return scored.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "p_unwanted")
