"""Boundary scan, images, redaction and canonical JSON on edge cases."""

import json
import random
import re

from pyspark.sql import functions as F

from feedweave.operators import boundary, export
from feedweave.sources import images

WORDS = ("/Users/", "\\Users\\", "gx10.local", "192.168.", "facebook.com", "__cft__", "scontent-", "https://", "fbcdn", "..", "../", "../..", " ../", " ../../..", "/", " ", "\n", "a", "x.ts", '"', "(", ")")


def plain_violations(path, content):
    """Line by line with the standard library's patterns."""
    out = set()
    for i, line in enumerate(content.split("\n"), 1):
        out |= {(path, i, f"forbidden content ({label})") for label, _, p in boundary.CONTENT if re.search(p, line)}
        for ref in re.findall(boundary.PARENT, line):
            depth = path.count("/")
            for s in ref.split("/"):
                depth += {"..": -1, ".": 0, "": 0}.get(s, 1)
                if depth < 0 and not path.startswith("src/"):
                    out.add((path, i, f"forbidden content ({boundary.PARENT_LABEL})"))
    return out


def test_boundary_equals_plain_version(spark):
    rng = random.Random(11)
    files = [(f"{rng.choice(['src', 'docs', 'a/b/c', 'lib'])}/f{i}", "file", "".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    want = set().union(*(plain_violations(p, c) for p, _, c in files))
    found = boundary.violations(spark.createDataFrame(files, "path string, kind string, content string")).collect()
    assert {tuple(r) for r in found} == want and len({r["finding"] for r in found}) == 6 and len(found) == len(want)


def test_boundary_places_links_and_binaries(spark):
    files = [
        (".env", "file", ""), (".envrc", "file", ""), (".env.local", "file", ""), ("data", "file", ""), ("database", "file", ""), ("distance/x", "file", ""), ("dist", "file", ""), ("a/data/x", "file", ""), ("tmp/x", "directory", None),
        ("link", "symlink", "/Users/x"), ("binary", "file", "\0/Users/x"), ("none", "file", None), ("dir", "directory", "/Users/x"),
    ]
    found = {(r["path"], r["line"], r["finding"]) for r in boundary.violations(spark.createDataFrame(files, "path string, kind string, content string")).collect()}
    assert {p for p, _, _ in found} == {".env", ".env.local", "data", "dist", "tmp/x", "link"} and all(line is None for _, line, _ in found)
    assert boundary.violations(spark.createDataFrame([], "path string, kind string, content string")).collect() == []


def chosen(spark, *htmls, most=4):
    rows = images.chosen(spark.createDataFrame(list(enumerate(htmls)), "page_id int, html string"), most).collect()
    return [(r["urls"], r["n_filtered"]) for r in sorted(rows)]


def test_images_of_content(spark):
    img = lambda src, more="": f'<img src="{src}" {more}>'
    assert chosen(
        spark,
        None, "", "<p>none</p>",
        img("https://h/a.jpg") + img("https://h/a.jpg") + img("https://h/b.jpg"),
        img("https://h/a.jpg", "width=99 height=300") + img("https://h/a.jpg", "width=100 height=100") + img("https://h/c.jpg", "width=5"),
        img("https://h/a.jpg", 'data-imgperflogname="profilePic"') + img("https://h/b.jpg", 'data-imgperflogname="feed"'),
        img("https://static.xx.fbcdn.net/x.png") + img("https://h/rsrc.php/x") + img("data:image/svg+xml,x") + img("https://h/x.GIF?q#f") + img("https://h/v?a=1&amp;_nc_video=1") + img("https://h/v?_nc_video=12"),
        '<video poster="https://h/v.jpg"></video>' + img("https://h/after.jpg") + '<imgs src="https://h/no.jpg"><div style="background-image:url(https://h/bg.jpg)">',
        '<img alt="a>b" srcset="https://h/s.jpg 1x, https://h/l.jpg 2x" src="https://h/s.jpg">' + "<IMG SRC='https://h/q.jpg'/>" + "<img src=https://h/u.jpg>",
    ) == [
        ([], 0), ([], 0), ([], 0), (["https://h/a.jpg", "https://h/b.jpg"], 0), (["https://h/a.jpg", "https://h/c.jpg"], 0), (["https://h/b.jpg"], 0), (["https://h/v?_nc_video=12"], 3),
        (["https://h/after.jpg", "https://h/v.jpg", "https://h/bg.jpg"], 0), (["https://h/l.jpg", "https://h/q.jpg", "https://h/u.jpg"], 0),
    ]
    # what can't be looked at counts only until the last image that is kept
    assert chosen(spark, img("x.gif") + img("https://h/1.gif") + img("https://h/a") + img("https://h/2.gif") + img("https://h/b") + img("https://h/3.gif"), most=3) == [(["x.gif", "https://h/a", "https://h/b"], 2)]


def one(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows)]


def test_redaction_at_any_depth(spark):
    value = {"settings": {"language": "en"}, "tierAApiKey": "secret-a", "nested": {"api_key": "secret-b", "apiKeyAccepted": True, "api-key": {"inner": 1}}, "list": [{"tierBApiKey": None}, [{"API-KEY": [1]}]], "apikeys": "x", "my api key": "y"}
    want = {"settings": {"language": "en"}, "tierAApiKey": "[redacted]", "nested": {"api_key": "[redacted]", "apiKeyAccepted": True, "api-key": "[redacted]"}, "list": [{"tierBApiKey": "[redacted]"}, [{"API-KEY": "[redacted]"}]], "apikeys": "x", "my api key": "y"}
    found = one(spark, export.redacted_json, json.dumps(value), "[1]", "null", "3", "{broken", None, "{}")
    assert json.loads(found[0]) == want and list(json.loads(found[0])) == list(value) and found[1:] == ["{}", "{}", "{}", None, None, "{}"]


def test_canonical_json(spark):
    cases = {
        '{"b":1,"a":[{"d":2,"c":3}, [ ]]}': '{"a":[{"c":3,"d":2},[]],"b":1}', '{"\\uff5e":1,"\\ud83d\\ude00":2,"A":3,"a":4,"10":5,"9":6}': '{"10":5,"9":6,"A":3,"a":4,"😀":2,"～":1}',
        "[1.0,1.50,-0.0,1e21,1e-7,0.000001,1e20,123456789012345678901,0.1,-2.5e-9,5e-324,100]": "[1,1.5,0,1e+21,1e-7,0.000001,100000000000000000000,123456789012345680000,0.1,-2.5e-9,5e-324,100]",
        '"a\\u0000\\n\\"\\\\é"': '"a\\u0000\\n\\"\\\\é"', "[true,false,null]": "[true,false,null]", '{"a":1,"a":2}': '{"a":2}', "{": None,
    }
    assert one(spark, export.canonical_json, *cases) == list(cases.values())


def test_reports_of_tabs_with_parts_missing(spark):
    logs = spark.createDataFrame([(1, "b", 2, "second"), (1, "b", 1, "first"), (1, "a", 9, "other")], "tab int, component string, seq int, entry string")
    settings = spark.createDataFrame([(2, '{"apiKey":"s","x":1}')], "tab int, body string")
    events = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (3, 1, "only")], "tab int, seq int, event string")
    found = {r["tab"]: json.loads(r["report"]) for r in export.snapshot(logs, settings, events, "b", "t").collect()}
    assert found[1] == {"build": "b", "at": "t", "storage": "{}", "logs": [{"component": "a", "entries": ["other"]}, {"component": "b", "entries": ["first", "second"]}], "events": ["new", "old"]}
    assert found[2] == {"build": "b", "at": "t", "storage": '{"apiKey":"[redacted]","x":1}', "logs": [], "events": []} and found[3]["events"] == ["only"]
