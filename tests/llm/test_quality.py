import re
from collections import Counter

from oracle import rows_of, sql_rows

from tidelake.llm.quality import assess
from tidelake.llm.queries import op4_quality
from tidelake.llm.sql import quality_sql

SF = "/root/testdata/sf0.001"


def brute(text):
    """Base figures of a text by plain loops."""
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(wins)
    hit = {k for i, w in enumerate(wins) if seen[w] > 1 for k in range(i, i + 5)}
    n_sym = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), n_sym, len(lines) - len(set(lines)), len(hit)


def test_same_as_sql(spark):
    assert rows_of(op4_quality(spark, SF)) == sql_rows(quality_sql(), SF)


def test_cases(spark):
    fine = "The quick brown fox jumps over the lazy dog by the river, and then it sleeps.\nNobody saw it leave the field that night."
    texts = [None, "", " \n\t", "a", fine, fine + "\n" + fine, "a b c d e a b c d e f", "w " * 3000, "x\x0by\x0cz\r\nq", "é漢 🙂 #$", "Home | About | Contact | Help | Terms | More | Else | Last | One | Two", fine + "\nAll rights reserved.", "\n".join(["same line here."] * 50)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(4, fine, 1)], "doc_id long, text string, kept int")
    got = {r.doc_id: r for r in assess(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert got[4].kept and got[11].kept and got[11].clean_text == fine
    assert not got[10].kept and not got[10].base_failed
    assert got[0].clean_text is None and not got[0].kept
    assert assess(docs).count() == len(texts) + 1 and assess(docs.limit(0)).count() == 0


def test_scaled_lines(spark):
    words = [f"mot{i % 97}x{i % 89}" for i in range(60)]
    long = " ".join(f"w{i * i % 211}" if i % 3 else f"u{i}" for i in range(20_000))
    french = "Il a dit « bonjour » puis « au revoir » et il est parti vers la ville avec ses amis."
    short = "The quick brown fox jumps over the lazy dog by the old river."
    fine = [french, f"{' '.join(words)} read more {' '.join(words[::-1])}.", long + ".", " ".join(f"a{i % 80} b{i % 41}" for i in range(2_000)) + ".", short + "\nThis work is licensed under the terms that are given in full on another page.", short + "\nIt fell by 5 % in May."]
    # one passage over and over, bars, a notice alone, two notices, a breadcrumb
    junk = [" ".join(words[:50] * 20), "Home | About | Contact | Help | Terms | More | Else | Last | One | Two", "This work is licensed under the terms that are given in full on another page.", "\n".join([short, "Subscribe to our mail and click here for all of our older letters.", "Sign in to read more of the letters that we have sent."]), "Home » News » World » Town » Street » House » Room » Wall » Clock » Hand"]
    docs = spark.createDataFrame(list(enumerate(fine + junk)), "doc_id long, text string")
    got = {r.doc_id: r for r in assess(docs).collect()}
    # lines of a small vocabulary whose windows repeat fail the base rule already
    assert [got[i].lost_chars for i in (0, 1, 2, 5)] == [0] * 4 and all(got[i].kept for i in (0, 1, 2, 4, 5))
    assert not any(got[i].kept for i in range(len(fine), len(fine + junk)))
    assert got[4].clean_text == short and got[len(fine)].lost_chars > 0
