"""The cleaner of copied text and the audit's scanner against the rules written as loops."""

import random
import re

from pyspark.sql import functions as F

from lectern.functions import copied as C
from lectern.operators import accepted as A


def loop_clean(text):
    t = re.sub(r"\r\n?", "\n", text or "")
    for a, b in ((" ", " "), ("’", "'"), ("​", ""), ("–", "-")):
        t = t.replace(a, b)
    lines = [re.sub("[ \t]+", " ", x).strip(" ") for x in t.strip().split("\n")]

    def title(x):
        return not re.search(C.ENDED, x) and bool(re.search(C.TITLES, x) or x.lower() in C.SECTIONS)

    def point(x):
        n = len(x.split())
        return x[:1] in "-*" or n <= 28 and (x.endswith(";") or not re.search(C.ENDED, x))

    def page(x):
        x, n = x.lower(), len(x.split())
        return bool(
            x in C.FRAGMENTS or re.search(C.PAGE, x) or re.search(C.CONTACT, x) or n <= 22 and re.search(C.ADDRESS, x) or n <= 12 and re.search(C.PHONE, x) and re.search(C.PHONE_WORDS, x)
            or re.search(C.LINK, x) or n <= 12 and re.search(C.LABELLED, x) or n <= 18 and re.search(C.NOTICE, x) or n <= 8 and "open access" in x
            or n <= 22 and re.search(C.LOCATIONS, x) and (re.search(C.PLACES, x) or x.count(",") >= 2) or n <= 5 and re.search(C.TAIL, x) or n <= 8 and re.search(C.TERMS, x)
        )

    kept, left = [], 0
    for x in lines:
        if not x:
            kept.append("")
            continue
        if left and point(x) and not title(x):
            left -= 1
            continue
        left = 0
        if x.lower() == C.BOX:
            left = 8
        elif not page(x):
            kept.append(x)
    out, now = [], ""
    for x in kept:
        broken = bool(re.search(r"\[[^\]]*$", now) and re.match(r"^[^\[]*\]", x))
        number = bool(re.search(r"\b[A-Za-z]+$", now) and re.match(r"^\d+(\.\d+)?\b", x))
        if x and now and not title(x) and (now.endswith("-") or broken or number or not re.search(C.ENDED, now) and (x[0].islower() or x[0] == "(")):
            now = now[:-1] + x if now.endswith("-") else now + ("" if broken else " ") + x
        else:
            out += [now] if now or x == "" else []
            if x == "":
                out.append("")
            now = x
    t = "\n".join([*out, now])
    t = re.sub(r"\bthe(mean|same|following|first|second)\b", r"the \1", re.sub(r"(?i)\baccuracymore\b", "accuracy more", t))
    t = re.sub(r"\bis(more|less|likely|not)\b", r"is \1", t)
    return re.sub(r"\n{3,}", "\n\n", re.sub("[ \t]+", " ", t)).strip()


LINES = [
    "Key points", "KEY POINTS", "- a point;", "short words go here", "A sentence that ends.", "", "", "Page 3 of 9", "42", "Introduction", "INTRO TO ALL", "2.1 The Method", "and goes on here", "(in brackets)", "a broken-", "word here",
    "cited [see", "Smith 2020] for more.", "no brackets]", "up to about", "12 of them", "12abc of them", "12.5x", "Tel. +44 20 7946 0958", "jane@x.org", "Email: jane", "email was sent to them all.", "https://a.b/c", "Source: https://a.b", "Copyright 2020 by all",
    "Department of Health, London, UK", "made by", "CC license", "the themean ismore than accuracymore", "Élan began", "élan went on", "* star", "x" * 40 + " long line without an end", "a b c d e f g h i j k l m n o p q r s t u v w x y z aa bb cc dd",
]


def test_cleaner_matches_loop(spark):
    r = random.Random(8)
    texts = ["\n".join(r.choice(LINES) for _ in range(r.randrange(30))) for _ in range(400)] + [None, "", " \n ", "\r\nOne’s line\r\nends.\r", "Key points\n" + "\n".join(f"point {i}" for i in range(12)), "\n".join(["line goes"] * 700)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").withColumn("got", C.clean_copied(F.col("text")))
    for x in df.collect():
        assert x.got == loop_clean(x.text), x.text


def test_audit_sentences(spark):
    cases = {
        "One. Two! Three? Four": 4, "Dr. Who paid 3.5 pounds at 5 p.m. in town.": 1, "See a.com now. It works.": 2, "Go to a.com. Then rest.": 1, "In the U.S. agency of law.": 1, "He left the U.K. They stayed.": 2,
        "Cats, dogs, etc. are here. Cats, etc. They are.": 3, "Ask the gov. They know.": 2, "Ask the gov. they know.": 1, "1.2.3 is a version.": 1, "": 0, "Wait... what": 4, "i.e. this. E.g. That.": 2,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", F.size(A.audit_sentences(F.col("t"))).alias("n"))
    assert {x.t: x.n for x in df.collect()} == cases
