"""URL rules and chat formatting against plain readings of their contracts."""
import hashlib
from collections import defaultdict

from kestrel.llm import chat, queries, url_filter
from tests.llm.conftest import ODD

URLS = [None, "", "no scheme", "http://", "http://Example.ORG", "HTTP://a.example.org/es/1", "x://example.org/es",
        "x://example.org/en/12?q=/es/", "x://example.org/en/2#/en/1", "x://b.com/fr/", "x://b.com/de/x",
        "x://notexample.org/en/1", "x://org/", "x://a.example.org:80/es/", "x://u@example.org/es/",
        "x://b.com://example.org/es/", "x://Ünï.com/de/ü", "x://a.org\n/es/", "x://example.org//es/", "x://com/de/"]


def judge(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits)[3:] if fits else (None, default)
    return host, path, rule, verdict


def test_trie_and_join_agree_with_brute_force(spark):
    more = queries.URL_RULES + [("b.com", "/fr/", "block"), ("com", "", "block"), ("example.org", "/e", "allow"),
                                ("example.org", "/en/1", "allow"), ("c.d.net", "/", "allow")]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    for rules in (queries.URL_RULES, more, []):
        table = spark.createDataFrame(rules, "host string, path string, verdict string")
        for bound in (10**6, -1):
            got = url_filter.filter_urls(pages, table, trie_bytes=bound).collect()
            assert len(got) == len(URLS) * 2
            for r in got:
                assert (r.host, r.path, r.rule, r.verdict) == judge(r.url, rules), r.url


def test_empty_pages(spark):
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


def test_chat_round_trip(spark):
    rows = []
    for c, n in enumerate([1, 2, 3, 8, 41]):
        rows += [(c, t, ["user", "assistant", "system"][(t + c) % 3 if c % 2 else t % 2], ODD[(t + c) % len(ODD)])
                 for t in range(n)]
    rows += [(50, 0, "user", None), (50, 1, "assistant", None), (51, None, None, "x"), (51, 1, "a|>b\n<|", "y"),
             (None, 0, "user", "q"), (None, 1, "assistant", "r"), (52, 3, "assistant", "tie b"),
             (52, 3, "assistant", "tie a"), (52, 3, "assistant", "tie a"), (53, 0, "assistant", "long " * 40000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, example string")
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append((t is not None, t or 0, role or "", text or ""))
    examples = chat.format_chats(df)
    by = defaultdict(list)
    for e in examples.collect():
        by[e.conv_id].append(e)
    for c, turns in convs.items():
        turns = [(r, x) for *_, r, x in sorted(turns)]
        targets = [i for i, (r, _) in enumerate(turns) if r == "assistant"]
        found = sorted(by[c], key=lambda e: e.example)
        assert len(found) == len(targets) + (not targets or targets[-1] != len(turns) - 1)
        for e, i in zip(found, targets):
            assert chat.END not in e.text[e.loss_start:e.loss_end] and "</s>" not in e.text and "[INST]" not in e.text
            assert e.text.count(chat.END) == i + 1 and e.text[e.loss_end:] == chat.END
        assert found[-1].last and not any(e.last for e in found[:-1])
    for r in chat.read_back(examples).collect():
        turns = [(a, x) for *_, a, x in sorted(convs[r.conv_id])]
        said = "".join(f"{a}\n{x}\n" for a, x in turns)
        loss = "".join(x for a, x in turns if a == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (
            len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_is_native_and_takes_empty_tables(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_chats(none))
    assert back.count() == 0
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_joined_rules_keep_columns_of_their_names(spark):
    from kestrel.llm import url_filter
    pages = spark.createDataFrame([(1, "http://a.org/x", "h", "p"), (2, None, None, None)], "page_id long, url string, __h string, __p string")
    rules = spark.createDataFrame([("org", "/", "allow")], "host string, path string, verdict string")
    by_trie = url_filter.filter_urls(pages, rules).orderBy("page_id").collect()
    by_join = url_filter.filter_urls(pages, rules, trie_bytes=0).orderBy("page_id").collect()
    assert by_trie == by_join and by_join[0]["__h"] == "h" and by_join[0]["rule"] == "org/"
