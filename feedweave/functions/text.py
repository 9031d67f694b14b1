"""Text expressions over columns: normalisation, labels, predicates and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases, labels and marks whose wording decides results.
BAIT = (
    r"share if you agree",
    r"tag someone who",
    r"like if you",
    r"type\s+(yes|amen|1)\s+in\s+(the\s+)?comments?",
    r"comment\s+\w+\s+if",
    r"share\s+before\s+it('s|\s+is)\s+(deleted|removed|gone)",
    r"bet you can'?t name",
    r"only\s+\d+%?\s+(of\s+people\s+)?(can|will)",
    r"don'?t\s+scroll\s+without",
    r"ignore\s+if\s+you",
)
SUGGESTED = ("Suggested for you", "Suggested", "People You May Know", "People you may know", "為你推薦", "推薦", "你可能認識的朋友", "おすすめ", "あなたへのおすすめ", "知り合いかも")
SHORT_LABELS = ("贊助", "助贊", "Sponsored", "广告", "廣告", "スポンサー")
EMOJI = r"[\x{1F300}-\x{1F9FF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}\x{1F000}-\x{1F02F}\x{1F0A0}-\x{1F0FF}\x{200D}\x{20E3}\x{E0020}-\x{E007F}]"
SPACED_AD = r"(?i)(^|[^A-Za-z])S\s+s\s+o\s+p\s+r\s+n\s+e\s+o\s+t\s+d\s+g(?=[^A-Za-z]|\z)"
RESERVED_PATHS = ("ads", "bookmarks", "business", "events", "friends", "gaming", "help", "login", "marketplace", "memories", "messages", "notifications", "pages", "privacy", "reel", "reels", "saved", "settings", "watch")
NO_FEED = ("messages", "settings", "marketplace", "watch", "gaming", "events", "notifications", "photo", "stories", "reel", "help", "privacy", "policies", "legal", "about", "business", "ads", "developers")
UNSUPPORTED_GROUPS = ("create", "discover", "joins", "notifications")
TRACKING = ("fbclid", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")
WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


# The same class for matching: Latin letters fail it after two tests.
WIDE_WS = r"[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
FAST_WS = r"[\x{20}\x{09}\x{0A}\x{0B}\x{0C}\x{0D}\x{A0}[\x{1680}-\x{FEFF}&&" + WIDE_WS + "]]"
WS_CHARS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def squeeze(c: Column) -> Column:
    """Runs of white space, Unicode's included, to one space; none at the ends.  A single space is one already and isn't replaced."""
    return F.trim(F.regexp_replace(c, f" {FAST_WS}+|(?! ){FAST_WS}{FAST_WS}*", " "))


def holds(c: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds one of the words, ASCII ones in any case: a cheap test before an expensive pattern."""
    latin = [w for w in words if w.isascii()]
    found = c.rlike("(?i)" + "|".join(latin)) if latin else F.lit(False)
    for w in words:
        if not w.isascii():
            found = F.contains(c, F.lit(w)) | found
    return found


def compact(c: Column) -> Column:
    """All white space removed and lower case: the form in which texts are compared."""
    return F.lower(F.regexp_replace(c, f"{FAST_WS}+", ""))


def nfkc(c: Column) -> Column:
    """Compatibility forms composed (NFKC): full-width and half-width letters, ligatures and the like in their usual form."""
    return F.when(c.isNotNull(), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True)))


def without_bidi(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x{200E}\x{200F}\x{202A}-\x{202E}]", "")


def is_bait(c: Column) -> Column:
    return c.rlike("(?i)" + "|".join(BAIT))


def emoji_density(c: Column) -> Column:
    """Emoji matches over code points; 0 for an empty text."""
    return F.when(F.length(c) > 0, F.regexp_count(c, F.lit(EMOJI)) / F.length(c)).otherwise(F.lit(0.0))


def first_lines(c: Column, n: int = 5) -> Column:
    return F.array_join(F.slice(F.split(c, "\n"), 1, n), "\n")


def has_label(c: Column, labels: tuple[str, ...]) -> Column:
    """One of the labels within the first five lines."""
    head = first_lines(c)
    found = F.lit(False)
    for label in labels:
        found = found | F.contains(head, F.lit(label))
    return found


def is_short_label(c: Column) -> Column:
    """A header that is a sponsor label, alone or before a separator: at most 30 characters."""
    ad = squeeze(c).rlike(r"^Ad\z|^Ad\s*[·•]\s*(?:🌐)?\z")
    label = c.rlike("^(" + "|".join(SHORT_LABELS) + r")(\z|[ \x{00A0}·•])")
    return (F.length(c) <= 30) & (ad | label)


def has_delimited_label(c: Column) -> Column:
    """A sponsor label whose first occurrence stands between separators or ends: at most 60 characters."""
    edge = [" ", " ", "·", "•", ""]
    found = F.lit(False)
    for label in SHORT_LABELS:
        at = F.locate(label, c)
        before = F.when(at > 1, F.substring(c, at - 1, F.lit(1))).otherwise(F.lit(""))
        after = F.substring(c, at + len(label), F.lit(1))
        found = found | ((at > 0) & before.isin(*edge) & after.isin(*edge))
    return (F.length(c) <= 60) & found


def is_spaced_ad(c: Column) -> Column:
    return (F.length(squeeze(c)).between(1, 180)) & squeeze(c).rlike(SPACED_AD)


def dispatch_text(c: Column) -> Column:
    """Expand labels off, white space squeezed."""
    return squeeze(F.regexp_replace(c, r"(?m)(See more|查看更多|顯示更多)[ \t]*$", ""))


def first_sentence(c: Column) -> Column:
    found = F.regexp_extract(c, r"^[^\n]{1,90}?[。！？!?]", 0)
    return F.when(found != "", found).otherwise(F.left(c, F.lit(90)))


def truncated(c: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(mark))).otherwise(c)


def compatible_authors(a: Column, b: Column) -> Column:
    """Too short to tell, or one normalised name holds the other."""
    x, y = (F.lower(squeeze(F.regexp_extract(v, "^[^·•─✓]*", 0))) for v in (a, b))
    return (F.length(x) < 2) | (F.length(y) < 2) | F.contains(x, y) | F.contains(y, x)


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^https?://([^/?#:]+)", 1))


def path(c: Column) -> Column:
    return F.regexp_extract(c, r"^https?://[^/?#]+([^?#]*)", 1)


def is_feed_like(path: Column) -> Column:
    """A path where posts are expected: home, a group or a profile, none of the areas without a feed."""
    return ~path.rlike("^/(" + "|".join(NO_FEED) + ")") & path.rlike(r"^/\z|^/groups/[^/]+/?\z|^/[^/]+/?\z")


def page_kind(c: Column) -> Column:
    """What kind of page a URL is: feed, group, post, profileOrPage, unsupportedFacebook or nonFacebook."""
    h, parts = host(c), F.filter(F.split(F.lower(path(c)), "/"), lambda x: F.trim(x) != "")
    first, second = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    return (
        F.when(~((h == "facebook.com") | h.endswith(".facebook.com")), "nonFacebook").when((F.size(parts) == 0) | (first == "home.php"), "feed")
        .when(first == "groups", F.when(second.isNull() | second.isin(*UNSUPPORTED_GROUPS), "unsupportedFacebook").otherwise("group"))
        .when(first.isin("profile.php", "people"), "profileOrPage").when(first.isin("permalink.php", "story.php", "photo.php"), "post").when(first.isin(*RESERVED_PATHS), "unsupportedFacebook")
        .when((F.size(parts) == 1) | second.isin("posts", "photos", "videos"), "profileOrPage").otherwise("unsupportedFacebook")
    )


def without_tracking(c: Column) -> Column:
    """Tracking parameters and the fragment off a URL."""
    bare = F.regexp_replace(c, "#.*", "")
    bare = F.regexp_replace(bare, "([?&])(?:" + "|".join(TRACKING) + ")=[^&]*", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "&+", "&"), "[?]&", "?"), r"[?&]+\z", "")


def unit_codes(c: Column) -> Column:
    """The UTF-16 units of a text as numbers."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    pair = lambda x: F.array(F.lit(0xD800).cast("long") + F.shiftright(x - 0x10000, 10), F.lit(0xDC00).cast("long") + (x - 0x10000).bitwiseAND(0x3FF))
    return F.flatten(F.transform(codes, lambda x: F.when(x > 0xFFFF, pair(x)).otherwise(F.array(x))))


def djb2(c: Column) -> Column:
    """The 32-bit djb2 hash of a string's UTF-16 units."""
    return F.aggregate(unit_codes(c), F.lit(5381).cast("long"), lambda h, x: ((h * 33) + x).bitwiseAND(0xFFFFFFFF))


def units(c: Column) -> Column:
    """A text's length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.shiftright(F.octet_length(F.encode(c, "UTF-16BE")), 1)


def left_units(c: Column, n: int) -> Column:
    """The first ``n`` UTF-16 units of a text; a character that the cut would halve is left out."""
    raw = F.substring(F.encode(c, "UTF-16BE"), 1, 2 * n)
    halved = F.hex(F.substring(raw, 2 * n - 1, 1)).rlike("^D[89AB]")
    cut = F.decode(F.when(halved, F.substring(raw, 1, 2 * n - 2)).otherwise(raw), "UTF-16BE")
    return F.when(F.length(c) <= n // 2, c).otherwise(cut)
