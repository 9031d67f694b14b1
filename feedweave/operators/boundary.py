"""What must not leave: files at denied places, and lines with private hosts, paths, addresses or captured links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Places that are denied, what makes a line suspect, and the pattern that proves it.
DENIED = (
    ("environment file", r"^[.]env(\z|[.])"), ("local data directory", r"^data(\z|/)"), ("temporary output directory", r"^tmp(\z|/)"), ("build output directory", r"^dist(\z|/|-)"),
    ("test result directory", r"^test-results(\z|/)"), ("dependency install output", r"^node_modules(\z|/)"), ("local IDE state", r"^[.]idea(\z|/)"),
)
CONTENT = (
    ("absolute local user path", "users", r"[/\\]Users[/\\]"), ("private host", "gx10.local", r"(?i)gx10[.]local"), ("private IPv4 range", "192.168.", r"192[.]168[.]"),
    ("raw Facebook tracking URL", "__cft__", r"(?i)facebook[.]com[^\s)]*__cft__"), ("Facebook CDN capture", "scontent-", r"(?i)scontent-"), ("Facebook CDN capture", "fbcdn", r"(?i)https?://[^\s\"'`)]*fbcdn"),
)
PARENT = r"(?:^|[\"'`\s(:=])(\.\.(?:[/\\][^\"'`\s),;]+)+)"
PARENT_LABEL, EXEMPT = "parent-directory reference outside public root", r"^src(\z|/)"


def leaves_root(path: Column, reference: Column) -> Column:
    """Whether a reference like ``../../x`` from the file at ``path`` leads above the root: somewhere on the way more steps go up than down."""
    move = lambda s: F.when(s.isin("", "."), 0).when(s == "..", -1).otherwise(1)
    start = F.struct((F.size(F.split(path, "/")) - 1).alias("depth"), F.lit(False).alias("out"))
    step = lambda at, s: F.struct((at["depth"] + move(s)).alias("depth"), (at["out"] | (at["depth"] + move(s) < 0)).alias("out"))
    return F.aggregate(F.split(reference, "/"), start, step)["out"]


def violations(files: DataFrame) -> DataFrame:
    """``path, line, finding`` for ``files(path, kind, content)``: denied places and links have no line, content names each line it is on, from 1.

    Links are reported and not read; contents with a null character are binary and not read either.  A file's lines are only looked at one by
    one if it holds one of the words without which no rule can match, so most files are dismissed by substring tests.
    """
    links = files.where("kind = 'symlink'").select("path", F.lit(None).cast("int").alias("line"), F.lit("symlink is not allowed").alias("finding"))
    rest = files.where("kind <> 'symlink'")
    places = rest.select("path", F.explode(F.array_compact(F.array(*(F.when(F.col("path").rlike(p), f"denied path ({label})") for label, p in DENIED)))).alias("finding"))
    low = F.lower("content")
    text = rest.where((F.col("kind") == "file") & ~F.contains("content", F.lit("\0")))
    suspect = F.contains("content", F.lit(".."))
    for _, word, _ in CONTENT:
        suspect = suspect | F.contains(low, F.lit(word))
    lines = text.where(suspect).select("path", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    outside = F.exists(F.regexp_extract_all("text", F.lit(PARENT), F.lit(1)), lambda r: leaves_root(F.col("path"), r)) & ~F.col("path").rlike(EXEMPT)
    found = {label: F.lit(False) for label, _, _ in CONTENT}
    for label, _, pattern in CONTENT:
        found[label] = found[label] | F.col("text").rlike(pattern)
    tests = [F.when(hit, f"forbidden content ({label})") for label, hit in {PARENT_LABEL: outside, **found}.items()]
    content = lines.select("path", (F.col("at") + 1).alias("line"), F.explode(F.array_compact(F.array(*tests))).alias("finding"))
    return links.union(places.select("path", F.lit(None).cast("int").alias("line"), "finding")).union(content)
