"""URL filters: rules on host and path, and a logistic regression on hashed character n-grams for all other URLs."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hashed slots of n-grams; the model's size is fixed by it.
FEATURES = 2**14
SIZES = (3, 4, 5)
REGULARIZATION = 1e-4
#: At most about so many labelled URLs are learnt from, taken by a hash of the URL.
TRAIN_ROWS = 20_000
#: Hosts of the labelled table, by label, without the last parts of a name.
BLOCKED = """
    casino-royal online-casino casinobonus lucky-slots slot-machines jackpot-city poker-room texas-poker royal-bets sports-betting
    betting-tips best-bets lottery-winner win-lottery win-a-prize prizes-winner free-spins freegift-cards free-iphone roulette-live
    cheap-meds online-pills diet-pills cheap-viagra viagra-shop cialis-store weight-loss-pills payday-loans quick-loans bad-credit-loans
    adult-videos adult-dating xxx-tube xxx-cams porn-hub1 free-porn sex-chat hot-singles escort-girls nude-pics
    adserver ads-network adclick click-ads popup-ads banner-ads track-clicks clicktrack tracker-pixel pixel-tracking
    link-farm spam-links seo-spam buy-links get-rich-quick make-money-fast crypto-doubler warez-downloads keygen-cracks malware-site
""".split()
ALLOWED = """
    news daily-news library city-library museum art-museum school primary-school university science science-notes
    history local-history garden northern-gardens music concert-hall theatre cinema-club recipes home-cooking kitchen
    weather weather-station travel train-station travel-notes health hospital clinic dentist forum open-forum
    maps wiki encyclopedia dictionary translation languages literature poetry bookshop reading-room writers
    football-club tennis athletics swimming mountain-hiking cycling fishing sailing photography drawing design
    engineering software developers opensource database statistics mathematics physics chemistry biology astronomy
    farm-shop bakery restaurant coffee-house tea-room hotel railway airport town-council parliament government
    foundation charity volunteers church community neighbours family parenting children education teachers
    winter-sports windows-doors window-cleaning thunder-river the-other-side rather-interesting another-nation the-nation
    station-road information attention intention tradition addition edition condition relation creation
    essex-county middlesex sussex-news classic-cars pharmacy-school betty-cakes alphabet addresses trackside-railway
    download-manual freedom-press winery-tours windmill advice adventure adelaide linked-data farmers-market
""".split()
#: More words of paths that are allowed.
SITE = """
    index about contact article articles archive blog post posts page pages help search login account profile gallery events
    calendar products services shop cart download docs manual guide tutorial reference report annual meeting minutes members
    photo video story stories review opening hours directions press release category tag user topic thread comment today
""".split()
#: What the labelled hosts and paths are completed by, alike for both labels, so that neither these nor the rules' places tell anything.
BEFORE = ["", "www.", "m.", "blog."]
AFTER = [".com", ".org", ".net", ".info", ".co.uk", ".de", ".example.com", ".io"]
FOLDERS = ["/", "/en/1/", "/de/", "/fr/3/", "/es/", "/x/", "/a/b/", "/2024/05/"]
ENDS = ["", ".html", "/", "?page=2&ref=x", "#top", "/7", ".php?id=3", "?utm_source=feed"]
FORMS = 8
#: A URL is blocked less often than not: all blocked ones together weigh so much of the labelled table.
BLOCKED_SHARE = 0.3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host_: Column, path_: Column, rules: dict[str, str]) -> Column:
    """The longest fitting rule (host/path) or null. A rule fits its host and all subdomains if the path starts with its own."""
    out = F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):
        h, _, p = text.partition("/")
        fits = ((host_ == h) | host_.endswith(f".{h}")) & path_.startswith(f"/{p}")
        out = F.when(fits, F.lit(text)).otherwise(out)
    return out


def grams(host_: Column, path_: Column) -> Column:
    """Character n-grams of the words in host and path, marked by where they come from; ends of words count as characters.

    Words stand between dots, hyphens, underscores, digits and, in paths, whatever is no ASCII letter or longer code
    point. The top-level domain and a language folder at the path's beginning are left out: these are places, which
    rules may decide by, not what a URL is about.
    """

    def of_size(whole: Column, mark: str, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole) - n + 1, F.lit(1))), lambda i: F.concat(F.lit(mark), F.substring(whole, i, F.lit(n))))

    def cut(text: Column, between: str, mark: str) -> Column:
        words = F.filter(F.split(text, between), lambda x: x != "")
        return F.flatten(F.transform(words, lambda x: F.flatten(F.array(*[of_size(F.concat(F.lit("^"), x, F.lit("$")), mark, n) for n in SIZES]))))

    rest = F.translate(F.regexp_replace(path_, "^/[A-Za-z]{2}(?=/|$)", ""), _UPPER, _LOWER)
    return F.concat(cut(F.regexp_replace(host_, "[.][^.]*$", ""), "[._0-9-]+", "h"), cut(rest, r"[\x00-\x60\x7B-\x7F]+", "p"))


def parsed(pages: DataFrame, rules: dict[str, str]) -> DataFrame:
    """pages with __host, __path and __rule."""
    out = pages.withColumn("__host", host(F.col("url"))).withColumn("__path", path(F.col("url")))
    return out.withColumn("__rule", rule(F.col("__host"), F.col("__path"), rules))


def features(df: DataFrame) -> DataFrame:
    """Adds features: hashed n-grams, of unit length, so that long URLs don't weigh more."""
    counted = HashingTF(numFeatures=FEATURES, binary=True, inputCol="__grams", outputCol="__counts").transform(df.withColumn("__grams", grams(F.col("__host"), F.col("__path"))))
    return Normalizer(inputCol="__counts", outputCol="features").transform(counted)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table (url, label 1 = block): blocked and allowed names, each as a host and as a path in FORMS forms.

    A URL is to be blocked if its host or its path is. Blocked hosts have allowed paths and blocked paths allowed
    hosts, so either half tells by itself; beginnings, folders, ends and domains are as often with either label.
    """
    quiet = ALLOWED + SITE

    def url(n: int, k: int, host_: str, name: str) -> str:
        path_ = name.replace("-", ("/", "-", "_", "")[k % 4])
        return f"http{'s' * (k % 2)}://{BEFORE[(n + k) % len(BEFORE)]}{host_}{AFTER[(n + 3 * k) % len(AFTER)]}{FOLDERS[(n * 5 + k) % len(FOLDERS)]}{path_}{ENDS[(n * 3 + k) % len(ENDS)]}"

    def other(n: int, k: int, names: list[str]) -> str:
        return names[(n * 37 + k * 11) % len(names)]

    rows = [(url(n, k, h, "" if k == 0 else other(n, k, quiet)), 1) for n, h in enumerate(BLOCKED) for k in range(FORMS)]
    rows += [(url(n, k, other(n, k, ALLOWED), p if k % 2 else f"{other(n, k, quiet)}-{p}"), 1) for n, p in enumerate(BLOCKED) for k in range(FORMS)]
    rows += [(url(n, k, h, "" if k == 0 else other(n, k, quiet) if k % 2 else f"{other(n, k, SITE)}-{other(n, k + 1, quiet)}"), 0) for n, h in enumerate(ALLOWED) for k in range(FORMS)]
    rows += [(url(n, k, other(n, k, ALLOWED), p), 0) for n, p in enumerate(quiet) for k in range(FORMS)]
    return spark.createDataFrame(rows, "url string, label int")


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> LogisticRegressionModel | None:
    """From (url, label 1 = block); the blocked weigh BLOCKED_SHARE of all. Null URLs and labels are left out; without any others there is no model."""
    usable = labelled.filter("url IS NOT NULL AND label IS NOT NULL").select("url", (F.col("label") > 0).cast("double").alias("label"))
    n = usable.count()
    if not n:
        return None
    share = min(1.0, rows / n)
    taken = usable.filter(F.xxhash64("url", F.lit("train")) <= F.lit(min(2**63 - 1, int(share * 2.0**64) - 2**63)))
    taken = features(taken.select(host(F.col("url")).alias("__host"), path(F.col("url")).alias("__path"), "url", "label"))
    # One sorted partition of a bounded sample: sums are added in one order, so reruns agree to the last bit.
    fitted = taken.select("url", "features", "label").coalesce(1).sortWithinPartitions("url", "label")
    count, blocked = fitted.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    weight = F.when(F.col("label") > 0, F.lit(BLOCKED_SHARE * count / max(blocked, 1.0))).otherwise(F.lit((1 - BLOCKED_SHARE) * count / max(count - blocked, 1.0)))
    fitted = fitted.withColumn("weight", weight).cache()
    model = LogisticRegression(maxIter=100, tol=1e-7, regParam=REGULARIZATION, standardization=False, weightCol="weight").fit(fitted)
    fitted.unpersist()
    return model


def judge(pages: DataFrame, rules: dict[str, str], model: LogisticRegressionModel | None) -> DataFrame:
    """pages (url, others) with __host, __path, __rule and __verdict: allow or block, by the longest rule, else by the model.

    Null URLs and those without :// have empty host and path and are judged by the model; without a model all that no
    rule decides is allowed. Rows stay as they are.
    """
    df = parsed(pages, rules)
    if model is None:
        blocked = F.lit(False)
    else:
        df = model.setPredictionCol("__prediction").setProbabilityCol("").setRawPredictionCol("").transform(features(df))
        blocked = F.col("__prediction") >= 0.5
    by_rule = F.element_at(F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]), F.col("__rule"))
    verdict = F.coalesce(by_rule, F.when(blocked, "block").otherwise("allow"))
    return df.withColumn("__verdict", verdict).select(*[F.col(f"`{c}`") for c in pages.columns], "__host", "__path", "__rule", "__verdict")
