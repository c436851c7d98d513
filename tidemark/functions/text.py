"""Text and HTML fragments as Column expressions: cleaning, JSON fields, page kinds, content tests.

Patterns name white space and word characters in ASCII on purpose: Java's and other
engines' classes differ outside it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .versions import canonical, date_like, normalized, three_key

_ENTITIES = r"(?i)&(?:nbsp|amp|lt|gt|quot);"
#: Names of version fields in embedded data.
VERSION_FIELDS = "version versionNumber latestVersion releaseVersion appVersion pkgVersion softwareVersion productVersion currentVersion stableVersion newVersion tag_name tagName".split()
#: Fields that look like versions but aren't the product's.
OTHER_FIELDS = "minimumOsVersion minimum_os_version requiredOsVersion sdkVersion sdk_version apiVersion api_version buildNumber build_number schemaVersion schema_version protocolVersion protocol_version releaseCandidateVersion minRequiredVersion compatibleVersion".split()
#: Words beside which a number is no product version.
NOISE_WORDS = "apache mit gpl bsd mpl lgpl license licence class= className javascript .js .css .map .json chunk webpack node_modules .min. src= href= viewBox width= height= macOS ios iphone ipad watchos tvOS windows android linux ubuntu debian centos minimum compatible".split()


def _either(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s\x{A0}]+", " "))


def clean_text(html: Column) -> Column:
    """Tags and common entities to blanks, white space squeezed."""
    return squeezed(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), _ENTITIES, " "))


def title(html: Column) -> Column:
    return clean_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def meta_text(html: Column) -> Column:
    return F.array_join(F.regexp_extract_all(html, F.lit(r"""(?i)<meta[^>]+(?:name|property)=["'](?:description|og:title|og:description)["'][^>]*content=["']([^"']*)["']"""), 1), " ")


def visible_text(html: Column) -> Column:
    """Text outside scripts, styles, drawings and comments."""
    kept = F.regexp_replace(html, r"(?is)<(script|style|svg|noscript|template)\b.*?</\1>", " ")
    return clean_text(F.regexp_replace(kept, r"(?s)<!--.*?-->", " "))


def body_text(html: Column) -> Column:
    """Text outside scripts and styles, line breaks kept."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " "), "<[^>]+>", " ")


def headings(html: Column, levels: str = "1-3") -> Column:
    """Texts of headings, joined by blanks."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<h[{levels}][^>]*>(.*?)</h[{levels}]>"), 1)
    return F.array_join(F.transform(found, clean_text), " ")


def drawings_to_text(html: Column) -> Column:
    """Inline drawings replaced by the texts in them."""
    parts = F.split(html, r"(?i)(?=<svg\b)", -1)

    def cut(x: Column) -> Column:
        drawing = F.regexp_extract(x, r"(?is)^<svg\b.*?</svg>", 0)
        texts = F.regexp_extract_all(drawing, F.lit(r"(?is)<(?:text|title|desc|tspan)\b[^>]*>(.*?)</(?:text|title|desc|tspan)>"), 1)
        kept = F.concat(F.lit(" "), F.array_join(F.filter(F.transform(texts, clean_text), lambda t: t != ""), " "), F.lit(" "))
        return F.when(drawing == "", x).otherwise(F.concat(kept, F.substr(x, F.length(drawing) + 1)))

    return F.array_join(F.transform(parts, cut), "")


def without_licences(text: Column) -> Column:
    """Licence names with numbers go: they aren't product versions."""
    return F.regexp_replace(text, r"(?i)(?:(?:gpl|lgpl|agpl|mpl|bsd|mit|apache|cc)\s*)?v?\d+(?:\.\d+){0,2}\s+licen[sc]e(?![A-Za-z0-9_])", " ")


def without_noise(text: Column) -> Column:
    """Numbers right after a noise word go, with the word."""
    return F.regexp_replace(text, rf"""(?i)(?:{_either(NOISE_WORDS)})[\s"'=:.]{{0,6}}v?\d+(?:\.\d+){{1,3}}""", " ")


def keyword_text(body: Column) -> Column:
    """Up to 80 characters of a line from each version word on, one a line."""
    return F.array_join(F.regexp_extract_all(body, F.lit(r"(?i)(?:version|ver\.?\s|release|changelog|download|下载|更新|版本)[^\n]{0,80}"), 0), "\n")


def structured_text(html: Column) -> Column:
    """Values of version fields in the embedded state of pages, one a line."""
    state = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*id=["']__(?:NEXT_DATA|INITIAL_STATE)__["'][^>]*>(.*?)</script>"""), 1)
    fields = F.flatten(F.transform(state, lambda s: F.regexp_extract_all(s, F.lit(rf"""(?i)["'](?:{_either([*VERSION_FIELDS, "name"])})["']\s*:\s*["']([^"']{{1,40}})["']"""), 1)))
    return F.array_join(F.transform(fields, lambda x: F.concat(F.lit("version:"), x)), "\n")


def links(html: Column) -> Column:
    """Targets of href and src that are absolute or begin at the root."""
    return F.filter(F.regexp_extract_all(html, F.lit(r"""(?i)(?:href|src)=["']([^"']+)["']"""), 1), lambda u: u.startswith("http") | u.startswith("/"))


def is_json(body: Column) -> Column:
    return F.regexp_extract(body, r"^\s*(.)", 1).isin("{", "[")


def json_version(body: Column) -> Column:
    """The product version in a JSON body: the field version first, then others; null if none."""
    exact = F.trim(F.regexp_extract(body, r"""(?i)["']version["']\s*:\s*["']([^"']{1,30})["']""", 1))
    other = F.regexp_extract(body, r"""(?i)["'](?:appVersion|latestVersion|releaseVersion|currentVersion|stableVersion|newVersion)["']\s*:\s*["']([^"']{1,30})["']""", 1)
    return F.when(exact.rlike("[0-9]") & ~exact.rlike(r"^\d{4}[-.]\d{2}[-.]\d{2}"), normalized(exact)).when(other != "", normalized(other))


def json_versions(body: Column) -> Column:
    """Distinct values of version fields in JSON, as far as they look like versions."""
    names = [*VERSION_FIELDS, "version_number", "packageVersion", "name", "display_version"]
    found = F.transform(F.regexp_extract_all(body, F.lit(rf"""(?i)["'](?:{_either(names)})["']\s*:\s*["']([^"']{{1,40}})["']"""), 1), lambda v: F.trim(v))
    bad = r"(?i)^[A-Za-z0-9_.-]+@|^https?://|^\d{4}[-.]?\d{2}[-.]?\d{2}|^\d{4}[.-]\d{1,2}|^[0-9a-f]{16,}$"
    return F.array_distinct(F.filter(found, lambda v: v.rlike("[0-9]") & (F.length(v) <= 30) & ~v.rlike(bad) & ~(v.rlike(r"^\d{6,}") & ~v.contains("."))))


def filename_versions(name: Column) -> Column:
    found = F.regexp_extract_all(name, F.lit(r"(?i)(?:^|[_-])(v?(?:0|[1-9]\d*)(?:\.(?:0|[1-9]\d*)){1,3})(?=[._-]|$)"), 1)
    return F.array_distinct(F.filter(found, lambda v: ~v.rlike(r"^\d{4}[-.]?\d{2}[-.]?\d{2}") & (F.length(v) <= 20)))


def domain(url: Column) -> Column:
    """Host in lower case without port and www."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)https?://([^/:]+)", 1)), r"^www\.", "")


def domain_matches(a: Column, b: Column) -> Column:
    """Equal, or one a subdomain of the other; empty ones match nothing."""
    return (a != "") & (b != "") & ((a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a)))


def blocked_host(url: Column) -> Column:
    """Loopback, private and link-local hosts, and what isn't plain http(s) without credentials."""
    host = F.regexp_extract(F.lower(url), r"^https?://\[?([^/:?#\]]*)", 1)
    private = host.rlike(r"^(?:10|127)\.\d+\.\d+\.\d+$|^172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+$|^192\.168\.\d+\.\d+$|^169\.254\.\d+\.\d+$")
    return F.coalesce(~url.rlike("(?i)^https?://[^/]") | url.rlike("^[^/]+//[^/]*@") | host.isin("", "localhost", "0.0.0.0") | host.rlike(r"\.local(?:host)?$") | url.rlike(r"^https?://\[::1?\]") | private, F.lit(True))


def language(text: Column) -> Column:
    """zh if over 5 % of the characters are Chinese, else en."""
    share = F.length(F.regexp_replace(text, r"[^\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]", "")) / F.greatest(F.length(text), F.lit(1))
    return F.when(share > 0.05, "zh").otherwise("en")


def tidy(markdown: Column) -> Column:
    return F.trim(F.regexp_replace(markdown, r"\n{3,}", "\n\n"))


def section_text(html: Column) -> Column:
    """A section's HTML without its frame; block ends become line breaks."""
    out = html
    for tag in ("style", "script", "head", "nav", "header", "footer", "svg"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<img[^>]*>", " "), r"(?i)</(?:li|ul|ol|div|table|tr|td|section|article)>|<br\s*/?>", "\n")
    for name, sign in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
        out = F.regexp_replace(out, f"(?i)&{name};", sign)
    return F.trim(out)


def changelog_kind(html: Column) -> Column:
    """plain-text, heading, blog, list, js-render or none: how a page sets out its versions."""
    heading = html.rlike(r"(?i)<h[1-4][^>]*>[^<]*v?\d+\.\d+[^<]*</h[1-4]>")
    empty_root = html.rlike(r"""(?i)<div\s+id=["'](?:root|app|__next)["'][^>]*>\s*</div>""") & ~html.rlike(r"<h[1-6][^>]*>[^<]*v?\d+\.\d+") & ~html.rlike(r"(?i)(?:Changes|Release|Version|Changelog)\s+(?:with\s+)?v?\d+\.\d+")
    bundle = html.rlike(r"""(?i)<script[^>]*src=["'][^"']*(?:_next|app\.|main\.|bundle)[^"']*["']""") & ~html.rlike(r"<h[1-6][^>]*>[^<]*v?\d+\.\d+") & ~html.rlike(r"(?<![A-Za-z0-9_])v?\d+\.\d+\.\d+(?![A-Za-z0-9_])")
    plain = html.rlike(r"(?i)(?<![A-Za-z0-9_])(?:Changes|Changelog)\s+(?:with\s+[A-Za-z0-9_.-]+\s+)?v?\d+\.\d+") | html.rlike(r"(?m)^[ \t]*v?\d+\.\d+\.\d+[ \t]*$")
    blog = html.rlike(r"""(?is)<a[^>]+href=["'][^"']*(?:release|news|blog)[^"']*["'][^>]*>.{0,80}?(?<![A-Za-z0-9_])v?\d+\.\d+""")
    listed = html.rlike(r"""(?is)<li>.{0,120}?<a[^>]+href=["'][^"']*\d+\.\d+["'][^>]*>""")
    return F.when(F.coalesce(html, F.lit("")) == "", "none").when(empty_root | bundle, "js-render").when(plain, "plain-text").when(heading, "heading").when(blog, "blog").when(listed, "list").otherwise("none")


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def not_a_changelog(text: Column) -> Column:
    """Too short, hashes, lists of URLs or of downloads."""
    lines = _lines(text)
    url = F.filter(lines, lambda x: x.rlike(r"^https?://\S+$") | (x.rlike("https?://") & (F.size(F.split(x, r"\s+")) <= 3)))
    hashes = F.size(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[0-9A-Fa-f]{32,}(?![A-Za-z0-9_])"), 0))
    files = (F.size(lines) <= 3) & F.forall(lines, lambda x: x.rlike(r"https?://\S+\s+\d+$") | x.rlike(r"(?<![A-Za-z0-9_])[0-9A-Fa-f]{32,}(?![A-Za-z0-9_])"))
    return F.coalesce((F.length(text) < 20) | (hashes >= 2) | ((F.size(lines) >= 2) & (F.size(url) / F.size(lines) > 0.5)) | files, F.lit(True))


def good_changelog(text: Column) -> Column:
    """Long enough, without HTML or boilerplate, and a changelog."""
    html = text.rlike(r"</?(?:li|ul|ol|div|table|td|a|img|svg|h[1-6])[\s>]")
    plate = text.rlike(r"(?i)Canonical URL|Creative Commons|Copyright|You are free to|\[Prev\]|\[Up\]|\[Next\]|Privacy Policy|Terms of Use")
    return F.coalesce((F.length(text) > 300) & ~html & ~plate & ~not_a_changelog(text), F.lit(False))


def header_version(html: Column) -> Column:
    """The version of the first line such as "Changes with name 1.2.3"; null if none."""
    return F.nullif(F.regexp_extract(html, r"(?i)(?:Changes?\s+with\s+[^\s<]+\s+|Fixed\s+in\s+)v?(\d+(?:\.\d+){1,3})(?=\s|<|$)", 1), F.lit(""))


def answer_version(answer: Column) -> Column:
    """The first version of two numbers or more in an answer."""
    found = F.regexp_extract(answer, r"(?i)v?(\d+(?:\.\d+){1,3})", 1)
    return F.when(found != "", canonical(found))


def context(text: Column, at: Column, width: int = 60) -> Column:
    """Text around a place (from 1), cleaned."""
    start = F.greatest(at - width, F.lit(1))
    return clean_text(F.substr(text, start, at - start + width))


def product_name(label: Column) -> Column:
    """The first word of two letters or more that isn't generic."""
    words = F.filter(F.split(F.lower(F.regexp_replace(label, r"[^A-Za-z\s]", " ")), r"\s+"), lambda w: (F.length(w) >= 2) & ~w.isin("the", "for", "app", "software", "download", "official", "release", "version"))
    return F.get(words, F.lit(0))


def standard_before(before: Column, names: list[str], platforms: list[str]) -> Column:
    """Whether text ends with a name of a standard, unless as in "for windows"."""
    words = F.filter(F.split(F.lower(before), r"[\s_/-]+"), lambda w: w != "")
    last, second = F.element_at(words, -1), F.try_element_at(words, F.lit(-2))
    return F.when(F.size(words) == 0, False).otherwise(last.isin(names) & ~(last.isin(platforms) & F.coalesce(second == "for", F.lit(False))))


def date_in(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?<!\d)(\d{4}[-/]\d{1,2}[-/]\d{1,2})(?!\d)", 1), F.lit(""))


def largest_link(html: Column) -> Column:
    """(version, href) of the link with the largest version; file and legal links and dates left out."""
    anchors = F.regexp_extract_all(html, F.lit(r"""(?is)<a[^>]+href=["'][^"']+["'][^>]*>.*?</a>"""), 0)
    rows = F.transform(anchors, lambda a: F.struct(F.regexp_extract(a, r"""(?i)href=["']([^"']+)["']""", 1).alias("href"), clean_text(a).alias("text")))
    legal = r"(?i)creativecommons|licen[sc]e|privacy|terms|imprint|about|legal"
    files = r"(?i)\.(?:css|js|map|exe|dmg|zip|msi|pkg|7z|tar\.gz|tar\.xz|tgz|txz|deb|rpm|apk|dll|iso)(?:\?|#|$)"
    rows = F.filter(rows, lambda x: ~x["href"].rlike(legal) & ~x["text"].rlike(legal) & ~x["href"].rlike(files))
    rows = F.transform(rows, lambda x: F.struct(F.regexp_extract(F.concat_ws(" ", x["href"], x["text"]), r"(?<![A-Za-z0-9_])v?(\d+(?:\.\d+){1,3})(?![A-Za-z0-9_])", 1).alias("version"), x["href"].alias("href")))
    rows = F.transform(F.filter(rows, lambda x: (x["version"] != "") & ~date_like(x["version"])), lambda x, i: F.struct(three_key(x["version"]).alias("key"), (-i).alias("ord"), x["version"].alias("version"), x["href"].alias("href")))
    return F.array_max(rows)
