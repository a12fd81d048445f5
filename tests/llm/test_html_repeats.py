"""Pages without an article on one large host: prose stays, also where it shares short runs or whole paragraphs; boilerplate goes."""

import random

from topograph.llm import html_extract


def test_prose_stays_on_a_large_host(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(12)]
    notice = "We use cookies to keep this site in good order and " + " ".join(f"n{i}" for i in range(40))
    shared = " ".join(f"s{i}" for i in range(60))
    rows, want = [], {}
    for i in range(60):
        prose = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(8)]
        prose += [shared] if i < 2 else [f"The small host number {i} said so"]
        body = "".join(f"<p>{p}</p>" for p in ["Sign up today", "and stay in touch with us every single day", *prose, notice])
        rows.append((i, f"http://large.org/{i}", f"<html><body>{body}</body></html>"))
        want[i] = "\n".join(prose)
    rows += [(100 + i, f"http://two.org/{i}", f"<p>{shared}</p><p>Page {i}</p>") for i in range(2)]
    want |= {100 + i: f"{shared}\nPage {i}" for i in range(2)}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df.unionByName(df)).collect()}
    assert got == want
