"""Rules that score a candidate link. Points are whole hundredths, so sums are exact."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions import rules
from docsieve.functions.text import any_of, bare_host, file_name, host, listed, spaced, two_digits

#: A year range such as 2023-24 or 2023-2024 without digits around it, wherever it starts.
RANGES = r"(?<!\d)(?=(\d{4}-(?:\d{4}|\d{2})(?!\d)))"
#: Annual report files of an exchange carry the fiscal year's first and last calendar year.
EXCHANGE_FILE = r"annual_reports/ar_\d+_[^/]+?_\d{4}_(\d{4})_"


def prepared(candidates: DataFrame) -> DataFrame:
    """Adds the forms of ``url`` that the rules read, each computed once."""
    low = F.lower("url")
    df = candidates.withColumns({"url_l": low, "file_l": file_name(low)})
    return df.withColumns({"url_s": spaced(F.col("url_l")), "file_s": spaced(F.col("file_l"))})


def non_annual(url: str = "url_l", spaced_url: str = "url_s", file: str = "file_l", spaced_file: str = "file_s") -> Column:
    """Which rule says that a link is no annual report: path, url, file, or null."""
    return (
        F.when(any_of(F.col(url), rules.REJECT_PATH), "path")
        .when(listed(F.col(url), rules.REJECT_URL) | listed(F.col(spaced_url), rules.REJECT_URL), "url")
        .when(listed(F.col(file), rules.REJECT_FILE) | listed(F.col(spaced_file), rules.REJECT_FILE), "file")
    )


def tier(doc_type: Column) -> Column:
    """1 confirmed, 2 unclear, 3 no annual report; only hyphens and underscores count as blanks here."""
    low = F.col("url_l")
    plain = any_of(low, rules.REJECT_PATH) | listed(low, rules.REJECT_URL) | listed(spaced(low, False), rules.REJECT_URL)
    named = listed(F.col("file_l"), rules.REJECT_FILE) | listed(spaced(F.col("file_l"), False), rules.REJECT_FILE)
    return F.when(doc_type != "annual_report", 2).when(plain | named, 3).when(listed(low, rules.ANNUAL), 1).otherwise(2)


def trusted(low: Column) -> Column:
    return listed(low, rules.TRUSTED_HOSTS)


def loosely(text: Column, year: Column) -> Column:
    """The year or a way to write it, other than a range with a hyphen, is in the text."""
    y, p, n = year.cast("string"), (year - 1).cast("string"), (year + 1).cast("string")
    yy, nn = two_digits(year), two_digits(year + 1)
    # What contains the four digits of the year needs no test of its own.
    forms = [F.concat(F.lit(a), b) for a, b in (("fy", yy), ("fy-", yy), ("fy_", yy), ("fy", nn), ("fy", n), ("fy-", nn), ("fy-", n), ("ar", nn), ("ar-", nn), ("annual", nn))]
    return reduce(lambda a, b: a | b, [text.contains(f) for f in [y, *forms, F.concat(p, F.lit("_"), yy)]])


def says_year(text: Column, year: Column) -> Column:
    """The year or a way to write it is in the text; a range must stand free of other digits."""
    p, yy = (year - 1).cast("string"), two_digits(year)
    loose = loosely(text, year)
    short = F.concat(p, F.lit("-"), yy)
    # Only a text that has the range at all is searched for ranges that stand free.
    return loose | (text.contains(short) & F.array_contains(F.regexp_extract_all(text, F.lit(RANGES), F.lit(1)), short))


def year_rule():
    """The rule of ``year_points`` over Arrow columns, as a function of its own parts, so that tasks need nothing of this library."""
    year_of, range_of, known = re.compile(r"(?:19|20)[0-9]{2}"), re.compile(r"[0-9]{4}-[0-9]{2}"), {}

    def written(year: int):
        """Ways to write a year, the range that ends with it and must stand free of other digits, and ways to write an older one in a file's name."""
        y, p, n = str(year), str(year - 1), str(year + 1)
        yy, nn, pp, oo = y[2:4], n[2:4], p[2:4], str(year - 2)[2:4]
        forms = (y, f"fy{yy}", f"fy-{yy}", f"fy_{yy}", f"fy{nn}", f"fy{n}", f"fy-{nn}", f"fy-{n}", f"ar{nn}", f"ar-{nn}", f"annual{nn}", f"{p}_{yy}")
        free = re.compile(f"(?<![0-9]){p}-{yy}(?![0-9])") if range_of.fullmatch(f"{p}-{yy}") else None
        return forms, free, (f"fy{pp}", f"fy-{pp}", f"fy_{pp}", f"fy{p}", f"fy-{p}", f"fy{oo}", f"fy-{oo}")

    def points(url: str, file: str, year: int | None) -> int:
        found = year_of.findall(url)
        if year is None:
            return -1 if found else 0
        if year not in known:
            known[year] = written(year)
        forms, free, older = known[year]
        says = lambda text: any(map(text.__contains__, forms)) or bool(free and free.search(text))
        if says(file):
            return 50
        named = year_of.findall(file)
        if any(map(file.__contains__, older)) or (named and min(named) < forms[0]) or (found and min(found) > forms[0]):
            return -1
        return 50 if says(url) else -1 if found else 0

    def points_of_years(urls: pa.Array, files: pa.Array, years: pa.Array) -> pa.Array:
        whole = years.to_pylist() if years.null_count else years.to_numpy().tolist()
        rows = zip(urls.to_numpy(zero_copy_only=False), files.to_numpy(zero_copy_only=False), whole, strict=True)
        return pa.array([0 if u is None else points(u, f, y) for u, f, y in rows], pa.int32())

    return points_of_years


def year_points(year: Column) -> Column:
    """50, 0 or -1 (another year): the file name counts before the rest of the URL."""
    url = F.col("url_l")
    closing = F.when(url.contains("annual_reports/ar_"), F.nullif(F.regexp_extract(url, EXCHANGE_FILE, 1), F.lit("")).cast("int"))
    # Not marked as deterministic, so that a filter on points or scores stays behind them: pushed before, Spark would score every link twice.
    points = F.arrow_udf(year_rule(), "int").asNondeterministic()(url, F.col("file_l"), year.cast("int"))
    return F.when(closing == year, 50).when(closing > year, -1).when(closing.isNotNull(), 0).otherwise(points)


def subsidiary(low: Column, name: Column) -> Column:
    return reduce(lambda a, b: a | b, [listed(F.lower(name), names) & listed(low, paths) for names, paths in rules.SUBSIDIARY_PATHS])


def source_points(low: Column, url: Column, ir_url: Column) -> Column:
    own, there = bare_host(ir_url), bare_host(url)
    return F.when((own != "") & F.contains(there, own), 40).when(trusted(low), 20).otherwise(0)


def language_points(low: Column) -> Column:
    return F.when(listed(low, rules.ENGLISH_URL), 15).when(listed(low, rules.FOREIGN_URL), 0).otherwise(5)


def name_points(low: Column, name: Column) -> Column:
    words = F.filter(F.split(F.trim(F.lower(name)), r"\s+"), lambda w: F.length(w) > 3)
    return F.when(F.exists(words, lambda w: F.contains(low, w)), 5).otherwise(0)


def scored(candidates: DataFrame, *, with_ir: bool = True, only_kept: bool = False) -> DataFrame:
    """Adds point columns, ``reject`` (the first rule that rules the link out, or null) and ``score``.

    Needs ``url, name, year, doc_type``, and ``ir_url``; ``head_status`` and ``content_type`` are null where the
    link was not looked up. The score is 0 for a link that is ruled out. With ``only_kept`` such links are left out, most of them before
    any points are worked out.
    """
    df = prepared(candidates)
    low, kind = F.col("url_l"), F.col("doc_type")
    press = listed(low, rules.PRESS_RELEASE)
    annual = kind == "annual_report"
    confirmed = F.when(annual & listed(low, rules.ANNUAL), 80).when((kind == "quarterly_report") & listed(low, rules.QUARTERLY), 80).otherwise(30)
    status = F.col("head_status")
    pdf = F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("pdf")) & (F.coalesce(status, F.lit(999)) < 400)
    # Each rule is null where it does not apply, so none is evaluated twice.
    reject = F.coalesce(
        F.when(listed(low, rules.RATING_HOSTS), "rating agency").when(subsidiary(low, F.col("name")), "subsidiary")
        .when(low.contains("press_release") & ~listed(low, ("annual", "report")), "press release"),
        F.when(annual, F.concat(F.lit("type: "), non_annual())),
        F.when((status >= 400) & ~status.isin(403, 405), "status")
        .when(~(low.endswith(".pdf") | pdf | F.rtrim(F.regexp_replace(low, "/+$", "")).endswith(".pdf") | trusted(low)), "no pdf"),
    )
    if only_kept:
        df = df.where(reject.isNull())
    df = df.withColumns({
        "type_points": F.greatest(confirmed - F.when(press, 20).otherwise(0), F.lit(0)),
        "year_points": year_points(F.col("year")),
        "source_points": source_points(low, F.col("url"), F.coalesce("ir_url", F.lit("")) if with_ir else F.lit("")),
        "language_points": language_points(low),
        "file_points": F.when(status < 400, 15).otherwise(5),
        "name_points": name_points(low, F.col("name")),
        "reject": F.lit(None).cast("string") if only_kept else reject,
    })
    if only_kept:
        df = df.where("year_points >= 0")
    df = df.withColumn("reject", F.coalesce("reject", F.when(F.col("year_points") < 0, "year")))
    points = sum((F.col(f"{p}_points") for p in ("year", "source", "language", "file", "name")), F.col("type_points"))
    return df.withColumn("score", F.when(F.col("reject").isNotNull(), 0.0).otherwise(points / F.lit(100.0)))


def link_rejected(low: Column, text: Column) -> Column:
    combined = F.concat_ws(" ", low, spaced(low), text)
    return any_of(low, rules.REJECT_PATH) | listed(combined, rules.LINK_REJECT)


def link_accepted(low: Column, text: Column) -> Column:
    return listed(F.concat_ws(" ", low, text), rules.LINK_ACCEPT)


def says_form(text: Column, year: Column) -> Column:
    """Any of ``requests.YEAR_FORMS`` is in the text."""
    return loosely(text, year) | text.contains(F.concat((year - 1).cast("string"), F.lit("-"), two_digits(year)))


def prior_year(low: Column, text: Column, year: Column) -> Column:
    """An earlier year of the last five is named and the year itself is not; the file name decides first."""
    file, both = file_name(low), F.concat_ws(" ", low, text)
    earlier = lambda t: reduce(lambda a, b: a | b, [t.contains((year - d).cast("string")) for d in range(1, 6)])
    return F.when(says_form(file, year), False).when(earlier(file), True).when(says_form(both, year), False).otherwise(earlier(both))


def link_points(low: Column, text: Column, year: Column, doc_type: Column) -> Column:
    """Quick score of a link in hundredths, without any look-up."""
    both = F.concat_ws(" ", low, text)
    typed = reduce(lambda c, k: c.when((doc_type == k) & listed(low, rules.LINK_TYPES[k]), 20), rules.LINK_TYPES, F.when(F.lit(False), 0)).otherwise(0)
    language = F.when(listed(both, rules.ENGLISH_LINK), 15).when(listed(both, rules.FOREIGN_LINK), -10).otherwise(0)
    points = F.when(says_form(both, year), 30).otherwise(-10) + typed + F.when(low.contains("report"), 10).otherwise(0) + language
    return F.when(prior_year(low, text, year), 0).otherwise(points)


def link_order(low: Column, text: Column, year: Column, doc_type: Column) -> list[Column]:
    """Sort keys of links: tier, whether the year is missing, language."""
    both = F.concat_ws(" ", low, text)
    rejected = any_of(low, rules.REJECT_PATH) | listed(both, rules.LINK_REJECT)
    level = F.when(doc_type != "annual_report", 2).when(rejected, 3).when(listed(both, rules.LINK_ACCEPT), 1).otherwise(2)
    language = F.when(listed(both, rules.ENGLISH_LINK), 0).when(listed(both, rules.FOREIGN_LINK), 2).otherwise(1)
    return [level, F.when(says_form(both, year), 0).otherwise(1), language]


def likely_quarterly(url: Column, title: Column) -> Column:
    text = F.lower(F.concat_ws(" ", url, title))
    text = F.lower(F.coalesce(F.try_url_decode(text), text))
    return ~listed(text, rules.ANNUAL_HIT) & listed(text, rules.QUARTERLY_HIT)


def identity_points(url: Column, title: Column, snippet: Column, tokens: Column, acronym: Column, ticker: Column, *, web: bool = False) -> Column:
    """How well a link belongs to a company, in hundredths: host, (path,) title, snippet.

    ``web`` is the stricter variant for search hits: a path test, and titles must have all words; a single word
    in a title then gives 40.
    """
    n = F.size(tokens)
    tick = F.lower(F.trim(F.coalesce(ticker, F.lit(""))))
    tick = F.when((n == 0) & (tick == ""), F.when(F.length(acronym) >= 3, acronym).otherwise("")).otherwise(tick)
    free = (n == 0) & (tick == "")
    strong = F.length(tick) >= 3
    h, t, s = host(url), F.lower(title), F.lower(snippet)
    flat = F.translate(h, "-.", "")
    word, root = F.coalesce(F.get(tokens, F.lit(0)), F.lit("\0")), F.translate(F.substring_index(h, ".", 1), "-_", "")
    slack = F.length(root) - F.length(word)
    one = (root == word) | (F.startswith(root, word) & (slack <= 4)) | (F.endswith(root, word) & (slack <= 7))
    found = F.size(F.filter(tokens, lambda x: F.contains(h, x)))
    by_host = F.when(n == 0, False).when(n == 1, one).otherwise(found >= F.when(n <= 2, n).otherwise(n - 1))
    has = lambda text: F.exists(tokens, lambda x: F.contains(text, x))
    every = lambda text: (n > 0) & F.forall(tokens, lambda x: F.contains(text, x))
    whole = F.array_contains(F.split(t, r"[^\p{L}\p{N}_]+"), word)
    ladder = F.when(free, 100).when(strong & F.contains(flat, tick), 100).when(by_host, 100)
    if web:
        low_path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
        slim = F.translate(low_path, "-_", "")
        ladder = ladder.when(strong & F.contains(slim, tick), 100).when(has(slim), 100)
    ladder = ladder.when(strong & F.contains(t, tick), 50)
    if web:
        ladder = ladder.when((n == 1) & whole, 40).when((n > 1) & every(t), 50)
    else:
        ladder = ladder.when((n == 1) & whole, 50).when((n > 1) & has(t), 50)
    return ladder.when(strong & F.contains(s, tick), 20).when(has(s), 20).otherwise(0)
