"""License scans by ordered signature rules.

Each rule is a hand-written pattern with a label, a keyword (one word) that every
text it matches must contain, and a priority.  Names of licenses are written once, and
three rules follow from each: a tag (``SPDX-License-Identifier: ...``), a notice
(``licensed under the ...``) and the bare title.  Tags outrank notices, notices
outrank titles, and of two names the one listed first outranks.

A text first passes a keyword gate; behind it only rules whose keyword occurs
are tried, on the whole text.  All places of all rules are intervals, and a
place that lies within a place of higher priority is suppressed, so ``GNU
General Public License, version 3`` is not also a GPL of any version.  The
labels of what is left join the base labels, which always stay.

Everything is SQL functions within the row: no shuffle and no Python.

Cases: a null or empty text has no words and no places; places of equal rules
on equal rows are equal; word positions count from 0 and are null without a
base place; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: phrase and label of the base detections
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# a space in a pattern stands for any white space, punctuation or line comment signs between two words
_V = r"(?:,? ?(?:version|v\.?|ver\.?))? ?"
_GNU = r"(?:gnu )?"
_LATER = r"(?:\+|,? or (?:\(at your option\) )?(?:any )?later(?: version)?)"
_NC, _SA, _ND = r"non-?commercial", r"share-?alike", r"no-?deriv(?:ative)?s?(?: works)?"
_CC = r"(?:creative commons|cc)"

#: (label, SPDX identifier, keyword, name): hand-written, the more special before the more general
NAMES: tuple[tuple[str, str, str, str], ...] = (
    ("agpl-3.0-or-later", r"agpl-3\.0(?:-or-later|\+)", "gpl", _GNU + r"(?:agpl|affero gpl)" + _V + r"3(?:\.0)?" + _LATER),
    ("agpl-3.0-or-later", r"agpl-3-or-later", "affero", _GNU + r"affero general public licen[sc]e" + _V + r"3(?:\.0)?" + _LATER),
    ("agpl-3.0", r"agpl-3\.0(?:-only)?", "affero", _GNU + r"affero general public licen[sc]e" + _V + r"3(?:\.0)?"),
    ("agpl-1.0", r"agpl-1\.0(?:-only|-or-later)?", "affero", r"affero general public licen[sc]e" + _V + r"1(?:\.0)?"),
    ("agpl", r"agpl", "affero", _GNU + r"affero general public licen[sc]e"),
    ("agpl-3.0", r"agplv?3", "agpl", r"agpl[- ]?v?3(?:\.0)?"),
    ("lgpl-3.0-or-later", r"lgpl-3\.0(?:-or-later|\+)", "lesser", _GNU + r"lesser general public licen[sc]e" + _V + r"3(?:\.0)?" + _LATER),
    ("lgpl-2.1-or-later", r"lgpl-2\.1(?:-or-later|\+)", "lesser", _GNU + r"lesser general public licen[sc]e" + _V + r"2\.1" + _LATER),
    ("lgpl-3.0", r"lgpl-3\.0(?:-only)?", "lesser", _GNU + r"lesser general public licen[sc]e" + _V + r"3(?:\.0)?"),
    ("lgpl-2.1", r"lgpl-2\.1(?:-only)?", "lesser", _GNU + r"lesser general public licen[sc]e" + _V + r"2\.1"),
    ("lgpl-2.0", r"lgpl-2\.0(?:-only|-or-later|\+)?", "library", _GNU + r"library general public licen[sc]e" + _V + r"2(?:\.0)?"),
    ("lgpl", r"lgpl", "lesser", _GNU + r"lesser general public licen[sc]e"),
    ("lgpl", r"lgpl-library", "library", _GNU + r"library general public licen[sc]e"),
    ("lgpl-3.0", r"lgplv?3", "lgpl", r"lgpl[- ]?v?3(?:\.0)?"),
    ("lgpl-2.1", r"lgplv?2\.1", "lgpl", r"lgpl[- ]?v?2\.1"),
    ("gpl-3.0-or-later", r"gpl-3\.0(?:-or-later|\+)", "general public", _GNU + r"general public licen[sc]e" + _V + r"3(?:\.0)?" + _LATER),
    ("gpl-2.0-or-later", r"gpl-2\.0(?:-or-later|\+)", "general public", _GNU + r"general public licen[sc]e" + _V + r"2(?:\.0)?" + _LATER),
    ("gpl-3.0", r"gpl-3\.0(?:-only)?", "general public", _GNU + r"general public licen[sc]e" + _V + r"3(?:\.0)?"),
    ("gpl-2.0", r"gpl-2\.0(?:-only)?", "general public", _GNU + r"general public licen[sc]e" + _V + r"2(?:\.0)?"),
    ("gpl-1.0", r"gpl-1\.0(?:-only|-or-later|\+)?", "general public", _GNU + r"general public licen[sc]e" + _V + r"1(?:\.0)?"),
    ("gpl-3.0", r"gplv?3", "gpl", r"gpl[- ]?v?3(?:\.0)?"),
    ("gpl-2.0", r"gplv?2", "gpl", r"gpl[- ]?v?2(?:\.0)?"),
    ("gpl", r"gpl", "general public", r"gnu general public licen[sc]e"),
    ("gfdl-1.3", r"gfdl-1\.3(?:-only|-or-later|\+)?", "documentation", _GNU + r"free documentation licen[sc]e" + _V + r"1\.3"),
    ("gfdl-1.2", r"gfdl-1\.2(?:-only|-or-later|\+)?", "documentation", _GNU + r"free documentation licen[sc]e" + _V + r"1\.2"),
    ("gfdl", r"gfdl", "documentation", _GNU + r"free documentation licen[sc]e"),
    ("apache-2.0", r"apache-2\.0", "apache", r"apache(?: software)? licen[sc]e" + _V + r"2(?:\.0)?"),
    ("apache-1.1", r"apache-1\.1", "apache", r"apache(?: software)? licen[sc]e" + _V + r"1\.1"),
    ("apache-1.0", r"apache-1\.0", "apache", r"apache(?: software)? licen[sc]e" + _V + r"1(?:\.0)?"),
    ("apache", r"apache", "apache", r"apache software licen[sc]e"),
    ("mit-0", r"mit-0", "mit", r"mit no attribution(?: licen[sc]e)?"),
    ("x11", r"x11", "x11", r"(?:mit )?x11 licen[sc]e"),
    ("mit", r"mit", "mit", r"(?:the )?mit(?: expat| x11)? licen[sc]e"),
    ("mit", r"mit-expat", "expat", r"expat licen[sc]e"),
    ("isc", r"isc", "isc", r"isc licen[sc]e"),
    ("0bsd", r"0bsd", "bsd", r"(?:zero|0)[- ]clause bsd(?: licen[sc]e)?"),
    ("bsd-4-clause", r"bsd-4-clause", "bsd", r"(?:four|4)[- ]clause bsd(?: licen[sc]e)?"),
    ("bsd-3-clause", r"bsd-3-clause", "bsd", r"(?:three|3)[- ]clause bsd(?: licen[sc]e)?"),
    ("bsd-2-clause", r"bsd-2-clause", "bsd", r"(?:two|2)[- ]clause bsd(?: licen[sc]e)?"),
    ("bsd-4-clause", r"bsd-original", "bsd", r"original bsd licen[sc]e"),
    ("bsd-3-clause", r"bsd-new", "bsd", r"(?:new|modified|revised) bsd licen[sc]e"),
    ("bsd-2-clause", r"bsd-simplified", "bsd", r"(?:simplified bsd|freebsd(?: bsd)?) licen[sc]e"),
    ("bsd-2-clause", r"bsd-2-simplified", "simplified", r"simplified licen[sc]e"),
    ("bsd", r"bsd", "bsd", r"bsd(?:[- ]style)? licen[sc]e"),
    ("bsd", r"bsd-style", "berkeley", r"berkeley software distribution(?:[- ]style)? licen[sc]e"),
    ("mpl-2.0", r"mpl-2\.0", "mozilla", r"mozilla public licen[sc]e" + _V + r"2(?:\.0)?"),
    ("mpl-1.1", r"mpl-1\.1", "mozilla", r"mozilla public licen[sc]e" + _V + r"1\.1"),
    ("mpl-1.0", r"mpl-1\.0", "mozilla", r"mozilla public licen[sc]e" + _V + r"1(?:\.0)?"),
    ("mpl", r"mpl", "mozilla", r"mozilla public licen[sc]e"),
    ("epl-2.0", r"epl-2\.0", "eclipse", r"eclipse public licen[sc]e" + _V + r"2(?:\.0)?"),
    ("epl-1.0", r"epl-1\.0", "eclipse", r"eclipse public licen[sc]e" + _V + r"1(?:\.0)?"),
    ("epl", r"epl", "eclipse", r"eclipse public licen[sc]e"),
    ("edl-1.0", r"edl-1\.0", "eclipse", r"eclipse distribution licen[sc]e"),
    ("cddl-1.1", r"cddl-1\.1", "common development", r"common development and distribution licen[sc]e" + _V + r"1\.1"),
    ("cddl-1.0", r"cddl-1\.0", "common development", r"common development and distribution licen[sc]e" + _V + r"1(?:\.0)?"),
    ("cpl-1.0", r"cpl-1\.0", "common public", r"common public licen[sc]e" + _V + r"(?:1(?:\.0)?)?"),
    ("cpal-1.0", r"cpal-1\.0", "attribution", r"common public attribution licen[sc]e"),
    ("ibm-1.0", r"ipl-1\.0", "ibm", r"ibm public licen[sc]e"),
    ("eupl-1.2", r"eupl-1\.2", "european", r"european union public licen[sc]e" + _V + r"1\.2"),
    ("eupl-1.1", r"eupl-1\.1", "european", r"european union public licen[sc]e" + _V + r"1\.1"),
    ("eupl", r"eupl", "european", r"european union public licen[sc]e"),
    ("artistic-2.0", r"artistic-2\.0", "artistic", r"artistic licen[sc]e" + _V + r"2(?:\.0)?"),
    ("artistic-1.0", r"artistic-1\.0(?:-perl)?", "artistic", r"artistic licen[sc]e" + _V + r"1(?:\.0)?"),
    ("artistic", r"artistic", "artistic", r"artistic licen[sc]e"),
    ("bsl-1.0", r"bsl-1\.0", "boost", r"boost software licen[sc]e"),
    ("busl-1.1", r"busl-1\.1", "business source", r"business source licen[sc]e"),
    ("sspl-1.0", r"sspl-1\.0", "server side", r"server side public licen[sc]e"),
    ("elastic-2.0", r"elastic-2\.0", "elastic", r"elastic licen[sc]e"),
    ("zlib", r"zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("libpng", r"libpng(?:-2\.0)?", "libpng", r"libpng licen[sc]e"),
    ("unlicense", r"unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", r"wtfpl", "what the", r"do what the f\S{1,6} you want to public licen[sc]e"),
    ("wtfpl", r"wtfpl-2\.0", "wtfpl", r"wtfpl"),
    ("ncsa", r"ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
    ("psf-2.0", r"psf-2\.0", "python", r"python software foundation licen[sc]e"),
    ("python-2.0", r"python-2\.0", "python", r"python licen[sc]e"),
    ("php-3.01", r"php-3\.0?1?", "php", r"php licen[sc]e"),
    ("ruby", r"ruby", "ruby", r"ruby licen[sc]e"),
    ("openssl", r"openssl", "openssl", r"openssl licen[sc]e"),
    ("postgresql", r"postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("curl", r"curl", "curl", r"curl licen[sc]e"),
    ("icu", r"icu", "icu", r"icu licen[sc]e"),
    ("unicode-dfs", r"unicode-(?:dfs-2016|3\.0)", "unicode", r"unicode licen[sc]e(?: agreement)?"),
    ("w3c", r"w3c", "w3c", r"w3c software (?:notice and )?licen[sc]e"),
    ("afl-3.0", r"afl-3\.0", "academic", r"academic free licen[sc]e"),
    ("osl-3.0", r"osl-3\.0", "open software", r"open software licen[sc]e"),
    ("ecl-2.0", r"ecl-2\.0", "educational", r"educational community licen[sc]e"),
    ("ms-pl", r"ms-pl", "microsoft", r"microsoft public licen[sc]e"),
    ("ms-rl", r"ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("ofl-1.1", r"ofl-1\.1", "sil", r"sil open font licen[sc]e"),
    ("mulanpsl-2.0", r"mulanpsl-2\.0", "mulan", r"mulan psl" + _V + r"2?|mulan permissive software licen[sc]e"),
    ("cecill-2.1", r"cecill-2\.1", "cecill", r"cecill(?: free software)? licen[sc]e"),
    ("vim", r"vim", "vim", r"vim licen[sc]e"),
    ("tcl", r"tcl", "tcl", r"tcl(?: tk)? licen[sc]e"),
    ("beerware", r"beerware", "beer", r"beer-?ware licen[sc]e"),
    ("upl-1.0", r"upl-1\.0", "permissive", r"universal permissive licen[sc]e"),
    ("nasa-1.3", r"nasa-1\.3", "nasa", r"nasa open source agreement"),
    ("qpl-1.0", r"qpl-1\.0", "public", r"q public licen[sc]e"),
    ("odbl-1.0", r"odbl-1\.0", "database", r"open database licen[sc]e"),
    ("odc-by-1.0", r"odc-by-1\.0", "attribution", r"open data commons attribution licen[sc]e"),
    ("pddl-1.0", r"pddl-1\.0", "public domain", r"public domain dedication and licen[sc]e"),
    ("ogl-uk-3.0", r"ogl-uk-3\.0", "government", r"open government licen[sc]e" + _V + r"(?:3(?:\.0)?)?"),
    ("cdla-permissive-2.0", r"cdla-permissive-2\.0", "community data", r"community data licen[sc]e agreement[- ]+permissive"),
    ("openrail-m", r"openrail-m", "rail", r"(?:creativeml )?open ?rail(?:-m|\+\+-m)?(?: licen[sc]e)?"),
    ("llama-community", r"llama-community", "llama", r"llama ?[234]?(?:\.\d)? community licen[sc]e"),
    *[
        (f"cc-{code}-{version}.0", rf"cc-{code}-{version}\.0", "cc" if short else "commons", (rf"cc[- ]{code}" if short else rf"creative commons[- ]+{long}(?: (?:inter|unported|generic)\w*)?(?: public)?(?: licen[sc]e)?") + _V + rf"{version}(?:\.0)?")
        for short in (True, False)
        for code, long in (
            ("by-nc-nd", rf"attribution[- ]+{_NC}[- ]+{_ND}"),
            ("by-nc-sa", rf"attribution[- ]+{_NC}[- ]+{_SA}"),
            ("by-nc", rf"attribution[- ]+{_NC}"),
            ("by-nd", rf"attribution[- ]+{_ND}"),
            ("by-sa", rf"attribution[- ]+{_SA}"),
            ("by", r"attribution"),
        )
        for version in (4, 3, 2)
    ],
    ("cc0-1.0", r"cc0-1\.0", "cc0", r"cc0(?: ?1\.0)?(?: universal)?"),
    ("cc0-1.0", r"cc0", "commons", r"creative commons zero"),
    ("cc-by-nc-nd", r"cc-by-nc-nd", "cc", r"cc[- ]by-nc-nd"),
    ("cc-by-nc-sa", r"cc-by-nc-sa", "cc", r"cc[- ]by-nc-sa"),
    ("cc-by-nc", r"cc-by-nc", "cc", r"cc[- ]by-nc"),
    ("cc-by-sa", r"cc-by-sa", "cc", r"cc[- ]by-sa"),
    ("cc-by-nd", r"cc-by-nd", "cc", r"cc[- ]by-nd"),
    ("cc-by", r"cc-by", "cc", r"cc[- ]by"),
    ("cc", r"cc", "commons", r"creative commons licen[sc]e"),
)

_NOTICE = r"(?:licen[sc]ed|released|distributed|available|provided|published|covered|governed) (?:under|by|according to)(?: the)?(?: terms(?: and conditions)? of(?: the)?)? "
_IDS = r"(?:[a-z0-9.+:-]+ (?:and|or|with) )*"
#: a tag goes on over an expression; an identifier that ends where the pattern does comes before one that goes on
_TAG = r"spdx-license-identifier: ?\(?(?:" + _IDS + r"({spdx})(?![a-z0-9+]|[.-][a-z0-9])|" + _IDS + r"({spdx}))"
_KINDS = (("tag", _TAG, 1.0), ("notice", r"(" + _NOTICE + r"(?:{name}))()", 0.95), ("title", r"({name})()", 0.8))
_GAP = r"[\s,;:.*#/|>'\"()\[\]-]{1,12}"


def _compiled(pattern: str) -> str:
    """The whole pattern: any case of A-Z, whole words, and free gaps where it has a space."""
    out, inside = [], False
    for i, c in enumerate(pattern):
        inside = (c == "[") or inside and c != "]" if pattern[i - 1 : i] != "\\" else inside
        if c == " " and not inside:
            out.append(_GAP if pattern[i + 1 : i + 2] != "?" else f"(?:{_GAP})")
        else:
            out.append(c)
    return rf"(?i)(?<![A-Za-z0-9])(?:{''.join(out)})(?![A-Za-z0-9])"


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, pattern, priority, weight); a greater priority wins, and no two are equal."""
    made = []
    for kind, form, weight in _KINDS:
        for label, spdx, keyword, name in NAMES:
            made.append((label, "spdx" if kind == "tag" else keyword.split()[0], _compiled(form.format(spdx=spdx, name=name)), weight))
    return [(label, keyword, pattern, len(made) - i, weight) for i, (label, keyword, pattern, weight) in enumerate(made)]


#: every rule's text, lower-cased, contains one of these; they open the gate
GATE = ("licen", "spdx", "common", "cc0", "cc-by", "cc by", "gpl", "bsd", "mulan", "wtfpl", "attribution", "nasa", "rail")


def _lengths(texts: Column) -> Column:
    return F.transform(texts, F.length)


def _places(text: Column, rule: Column) -> Column:
    """All places of a rule as (priority, from, to, label, weight); a place is what the pattern's two groups hold, which ends where its match does."""
    found = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    one, two = (_lengths(F.regexp_extract_all(text, rule["pattern"], F.lit(i))) for i in (1, 2))
    gaps, sizes = _lengths(F.split(text, rule["pattern"])), _lengths(found)
    held = F.zip_with(one, two, lambda a, b: a + b)
    start = F.aggregate(
        F.zip_with(F.slice(gaps, 1, F.size(sizes)), sizes, lambda g, s: F.struct(g.alias("gap"), s.alias("size"))),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<lo:int,hi:int>>)").alias("all")),
        lambda acc, x: F.struct((acc["at"] + x["gap"] + x["size"]).alias("at"), F.concat(acc["all"], F.array(F.struct((acc["at"] + x["gap"]).alias("lo"), (acc["at"] + x["gap"] + x["size"]).alias("hi")))).alias("all")),
    )
    places = F.zip_with(start["all"], held, lambda p, n: F.struct((p["hi"] - n).alias("lo"), p["hi"].alias("hi")))
    return F.transform(places, lambda p: F.struct(rule["priority"].alias("priority"), p["lo"].alias("lo"), p["hi"].alias("hi"), rule["label"].alias("label"), rule["weight"].alias("weight")))


PLACE = "struct<priority:int,lo:int,hi:int,label:string,weight:double>"


def _unsuppressed(places: Column) -> Column:
    """Places that lie within none of a greater priority, in one sweep from left to right.

    In order of start, the longer and then the greater priority first, all that
    hold a place come before it; of them only those that reach so far are kept
    in view, at most one a rule.
    """
    turned = F.transform(places, lambda p: F.struct(p["lo"].alias("lo"), (-p["hi"]).alias("end"), (-p["priority"]).alias("order"), p.alias("p")))
    none = F.expr(f"cast(array() as array<{PLACE}>)")

    def step(acc: Column, x: Column) -> Column:
        view = F.filter(acc["view"], lambda h: h["hi"] >= x["lo"])
        hidden = F.exists(view, lambda h: (h["priority"] > x["p"]["priority"]) & (h["hi"] >= x["p"]["hi"]))
        return F.struct(F.concat(view, F.array(x["p"])).alias("view"), F.when(hidden, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x["p"]))).alias("kept"))

    return F.aggregate(F.array_sort(turned), F.struct(none.alias("view"), none.alias("kept")), step, lambda acc: acc["kept"])


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are computed once a row, however often they are used: the generator keeps the optimizer from copying them."""
    made = F.struct(*[x.alias(name) for name, x in columns.items()])
    return rows.select("*", F.explode(F.array(made)).alias("__made")).select(*rows.columns, *[F.col(f"__made.{name}").alias(name) for name in columns])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    base = rf"(?<![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?i:{'|'.join(f'{SEP}+'.join(p.split()) for p, _ in BASE)})(?![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"
    known = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("keyword"), F.lit(c).alias("pattern"), F.lit(d).alias("priority"), F.lit(e).alias("weight")) for a, b, c, d, e in rules()])

    count = lambda x: F.regexp_count(x, F.lit(WORD)).cast("long")
    rows = _once(rows, n_words=count(F.col("text")), small=F.lower("text"))
    rows = _once(rows, gate=F.expr(" OR ".join(f"contains(small, '{x}')" for x in GATE)))
    live = F.filter(known, lambda r: F.contains(F.col("small"), r["keyword"]))
    found = F.flatten(F.transform(live, lambda r: _places(F.col("text"), r)))
    hits = F.regexp_extract_all("text", F.lit(base), F.lit(0))
    rows = _once(rows, places=F.when(F.col("gate"), found), hits=F.when(F.col("gate"), F.when(F.size(hits) > 0, hits)))
    kept = _unsuppressed(F.coalesce("places", F.expr(f"cast(array() as array<{PLACE}>)")))
    rows = _once(rows, detections=kept, pieces=F.when(F.col("hits").isNotNull(), F.split("text", base)))
    pieces = F.col("pieces")
    label = lambda h: F.coalesce(*[F.when(F.lower(F.substring(h, 1, 1)) == p[0], x) for p, x in BASE])
    base_labels = F.coalesce(F.array_sort(F.array_distinct(F.transform("hits", label))), F.expr("cast(array() as array<string>)"))
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size(F.col("hits")).cast("long") * F.col("hits").isNotNull().cast("long"), F.lit(0).cast("long")).alias("n_base"),
        count(F.get(pieces, F.lit(0))).alias("first_word"),
        (F.col("n_words") - count(F.element_at(pieces, -1)) - count(F.element_at("hits", -1))).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.transform("detections", lambda d: d["label"]))), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["weight"])), F.lit(0.0)), F.when(F.col("hits").isNotNull(), 0.7).otherwise(0.0)).alias("score"),
        "detections",
    )


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")
