"""The operators that judge texts one by one, and substring removal, against plain versions of their contracts."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

from sitegraph.llm import license_scan, packing, pii, quality_rules, substring_dedup, toxicity
from sitegraph.llm.entry import oracle_sql, queries

from .conftest import DOCS, SF, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def folders(odd):
    return [SF, odd]


def rows(spark, name, path, *key):
    found = queries()[name](spark, path).collect()
    return sorted((r.asDict() for r in found), key=lambda r: [(r[k] is not None, r[k] if r[k] is not None else 0) for k in key])


def same(found, wanted):
    """Equal as multisets of the wanted columns."""
    cut = [tuple((k, r[k]) for k in sorted(wanted[0])) for r in found] if wanted else []
    assert len(found) == len(wanted)
    assert Counter(cut) == Counter(tuple(sorted(w.items())) for w in wanted)


@pytest.mark.parametrize("name", ["op1_packing", "op4_toxicity", "op5_substring_dedup", "op6_license_scan", "op9_quality_rules", "op10_pii"])
def test_empty_table(spark, empty, name):
    assert queries()[name](spark, empty).collect() == []


def test_lengths_are_the_binary_form():
    assert packing.lengths(1740) == [1024, 512, 128, 64, 8, 4]
    assert packing.lengths(1) == [1] and packing.lengths(2048) == [1024, 1024]


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_tokenizer())
    library.encode_special_tokens = True
    for path in folders(odd):
        found = rows(spark, "op1_packing", path, "doc_id", "start")
        wanted = []
        for doc, text in texts(spark, path):
            ids = library.encode(text or "", add_special_tokens=False).ids + [0]
            at = 0
            for n in packing.lengths(len(ids)):
                raw = b"".join(i.to_bytes(4, "little") for i in ids[at : at + n])
                wanted.append({"doc_id": doc, "start": at, "length": n, "ids_crc32": zlib.crc32(raw), "doc_tokens": len(ids), "offset": 0})
                at += n
            assert at == len(ids)
        same(found, wanted)
        assert len({r["sequence_id"] for r in found}) == len(found)
        batches = Counter()
        for r in found:
            batches[r["batch_id"], r["length"]] += r["length"]
        assert len({b for b, _ in batches}) == len(batches) and max(batches.values()) <= 65_536


def test_special_strings(spark):
    """Ordinary text by default, their ids if asked for; all other texts have the ids of the library as it comes."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_tokenizer())
    plain, special = (packing.Encoder(packing.default_tokenizer(), x) for x in (False, True))
    text = "a<|endoftext|>b"
    assert special(text) == library.encode(text, add_special_tokens=False).ids == [64, 50256, 65]
    assert 50256 not in plain(text) and library.decode(plain(text)) == text
    for _, t in texts(spark, SF):
        assert plain(t or "") == special(t or "") == library.encode(t or "", add_special_tokens=False).ids


def test_packing_survives_hostile_texts():
    encode = packing.Encoder(packing.default_tokenizer())
    for text in (" " * 200_000, "a" * 100_000, "\n" * 50_000, " " * 20_000):
        assert len(encode(text)) > 0


def brute_removal(docs, size=50):
    where = {}
    for doc, text in docs:
        words = WORD.findall(text or "")
        for i in range(len(words) - size + 1):
            if doc is not None:
                key = tuple(words[i : i + size])
                where[key] = min(where.get(key, doc), doc)
    out = []
    for doc, text in docs:
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - size + 1):
            if doc is not None and where[tuple(words[i : i + size])] < doc:
                gone.update(range(i, i + size))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append({"doc_id": doc, "n_words": len(words), "n_removed": len(gone), "kept_sha256": hashlib.sha256(kept.encode()).hexdigest()})
    return out


def test_substring_dedup(spark, odd):
    for path in folders(odd):
        same(rows(spark, "op5_substring_dedup", path, "doc_id"), brute_removal(texts(spark, path)))


def test_a_passage_in_very_many_documents(spark):
    """Keys of more than a thousand windows are joined by broadcast; the result is that of brute force."""
    passage = " ".join(f"p{i}" for i in range(55))
    docs = [(i, f"own{i} {passage} tail{i} " + " ".join(f"q{i % 7}w{k}" for k in range(60))) for i in range(1100)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = substring_dedup.digest(substring_dedup.remove_repeats(spark, frame)).collect()
    same([r.asDict() for r in found], brute_removal(docs))


def test_the_sketch_keeps_its_bound():
    for characters in (0, 1 << 20, 1 << 34, 1 << 50):
        bits = substring_dedup.bits_for(characters, 1 << 31)
        assert bits >= 22 and 2 << bits <= 1 << 31
    assert substring_dedup.bits_for(36 << 24, 1 << 31) == 26


@pytest.mark.parametrize("path", [SF, "/root/testdata/sf0.01"])
def test_substring_dedup_against_sql(spark, path):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{path}/documents.parquet')")
    wanted = Counter(con.sql(oracle_sql()["op5_substring_dedup"]).fetchall())
    assert Counter(tuple(r) for r in queries()["op5_substring_dedup"](spark, path).collect()) == wanted


def test_licenses(spark, odd):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for path in folders(odd):
        wanted = []
        for doc, text in texts(spark, path):
            words = word.findall((text or "").translate(table))
            hits = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
            starts = [i for i, _ in hits]
            wanted.append({"doc_id": doc, "n_words": len(words), "n_base": len(hits), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted({x for _, x in hits}))})
        found = rows(spark, "op6_license_scan", path, "doc_id")
        same(found, wanted)
        for r in found:
            assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


def edited(notice, most, dice):
    chars = list(notice)
    for _ in range(dice.randint(0, most)):
        i = dice.randrange(len(chars))
        dice.choice([lambda: chars.__setitem__(i, "q"), lambda: chars.insert(i, "q"), lambda: chars.pop(i)])()
    return "".join(chars)


def test_fuzzy_notices_lose_none():
    """Every notice with up to its number of edits is found where it stands alone."""
    import random

    dice, scanner = random.Random(3), license_scan.Scanner()
    for notice, label, most in scanner.notices:
        for _ in range(5):
            text = "Some words. " + edited(notice, most, dice) + ", more"
            spans = license_scan.scan_text(text, scanner)[5]
            assert any(s["label"] == label for s in spans), (notice, text)
            for s in spans:
                assert 0 <= s["start"] < s["end"] <= len(text) and s["edits"] <= license_scan.max_edits(s["notice"])


def test_spans_equal_the_patterns_over_whole_texts(spark):
    """Brute force: each bounded-error pattern over the whole text, without seeds or regions."""
    import random

    dice, scanner = random.Random(11), license_scan.Scanner()
    names = [n for n, _, _ in scanner.notices]
    made = [" ".join(edited(n, 5, dice) if dice.random() < 0.7 else "lorem permit ipsum" for n in dice.choices(names, k=dice.randint(1, 9))) for _ in range(300)]
    made += ["mit " * 500 + "license", "licensed under the mit licence licensed under the mit license", "permit license", "license" * 300]
    made += [license_scan.words_of((t or "").encode())[2] for _, t in texts(spark, SF)]
    many = 0
    for text in made:
        wanted = sorted((m.start(), m.end(), sum(m.fuzzy_counts), i) for i, p in enumerate(scanner.patterns) for m in p.finditer(text))
        assert scanner.matches(text) == wanted, text[:200]
        many += len(wanted)
    assert many > 500
    spans = license_scan.scan_text("Licensed under the MIT licence; licensed under the MIT license", scanner)[5]
    assert [(s["start"], s["end"], s["edits"]) for s in spans if s["notice"].startswith("licensed")] == [(0, 30, 1), (32, 62, 0)]
    assert license_scan.scan_text("a permit license", scanner)[5] == []


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    where = {}
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(covered), "base_failed": failed}


def test_quality(spark, odd):
    for path in folders(odd):
        found = rows(spark, "op9_quality_rules", path, "doc_id")
        same(found, [{"doc_id": d, **plain_counts(t)} for d, t in texts(spark, path)])
        assert not any(r["kept"] and r["base_failed"] for r in found)
    clean = rows(spark, "op9_quality_rules", SF, "doc_id")
    assert sum(r["kept"] for r in clean) > len(clean) / 2


def plain_votes(text):
    """The rules' votes, counted from the text without the module's figures."""
    text = text or ""
    words = WORD.findall(text)
    n, chars = max(len(words), 1), "".join(words)
    size, lines = max(len(chars), 1), [x for x in text.split("\n") if WORD.search(x)]
    base = plain_counts(text)
    letters = re.findall("[A-Za-z]", text)
    symbols, punct = set("#*$%&|<>"), set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    enough, short = len(words) >= 40, len(words) <= 2000

    def vote(good, bad):
        return -1 if bad else 1 if good else 0

    mean, sym, rep = len(chars) / n, base["n_symbols"] / n, base["n_repeat_words"] / n
    dup, caps = base["n_dup_lines"] / max(len(lines), 1), sum(x.isupper() for x in letters) / max(len(letters), 1)
    kinds, digits = len(set(words)) / n, len(re.findall("[0-9]", text)) / size
    signed, bare = sum(bool(set(w) & symbols) for w in words) / n, sum(set(w) <= punct for w in words) / n
    marks, stutter = sum(c in punct for c in text) / size, sum(a == b for a, b in zip(words, words[1:])) / n
    return (
        vote(50 <= len(words) <= 50_000, len(words) < 20), vote(2.5 <= mean <= 10, mean < 2 or mean > 15), vote(sym <= 0.02, sym > 0.15),
        vote(enough and rep <= 0.1, rep > 0.3), vote(len(lines) >= 3 and dup <= 0.1, dup > 0.3),
        vote(len(letters) >= 40 and caps <= 0.15, len(letters) >= 40 and caps > 0.5),
        vote(enough and short and kinds >= 0.3, enough and short and kinds < 0.15), vote(enough and digits <= 0.05, digits > 0.3),
        vote(enough and signed <= 0.03, signed > 0.2), vote(enough and bare <= 0.03, bare > 0.1),
        vote(enough and marks <= 0.1, marks > 0.2), vote(enough and stutter <= 0.02, stutter > 0.2),
    )


def plain_em(votes, rounds=200):
    """Expectation-maximisation document by document, without patterns."""
    import math

    good, share = [1 / (1 + math.exp(2 * v.count(-1) - 3)) for v in votes], 0.85
    for _ in range(rounds):
        share = (sum(good) + 1) / (len(votes) + 2)
        table = []
        for c in (0, 1):
            own = [g if c else 1 - g for g in good]
            for r in range(len(votes[0])):
                cells = [1.0 + 2 * (x == (1 if c else -1)) + sum(w for w, v in zip(own, votes) if v[r] == x) for x in (-1, 0, 1)]
                table.append([x / sum(cells) for x in cells])
        k = len(votes[0])
        new = []
        for v in votes:
            odds = math.log(share / (1 - share)) + sum(math.log(table[k + r][x + 1] / table[r][x + 1]) for r, x in enumerate(v) if x)
            new.append(1 / (1 + math.exp(-max(-60.0, min(60.0, odds)))))
        change = max(abs(a - b) for a, b in zip(good, new))
        if change < 1e-9:
            break
        good = new
    return new


def test_verdicts_equal_a_plain_em(spark, odd):
    for path in folders(odd):
        docs = texts(spark, path)
        quality = plain_em([plain_votes(t) for _, t in docs])
        wanted = Counter((d, round(q, 5), q >= 0.5 and not plain_counts(t)["base_failed"]) for (d, t), q in zip(docs, quality))
        found = rows(spark, "op9_quality_rules", path, "doc_id")
        assert Counter((r["doc_id"], round(r["quality"], 5), r["kept"]) for r in found) == wanted


def test_quality_against_labels(spark):
    """Documents labelled bad go, most of them by the posterior alone; no good one goes but by the base rule."""
    path = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    found = [r for r in rows(spark, "op9_quality_rules", path, "doc_id") if r["doc_id"] in label and not r["base_failed"]]
    bad = [r for r in found if label[r["doc_id"]] == 0]
    assert len(bad) > 20 and sum(r["kept"] for r in bad) <= len(bad) // 20
    assert all(r["kept"] for r in found if label[r["doc_id"]] == 1)


def test_em_learns_which_rules_to_trust():
    import numpy as np

    dice = np.random.default_rng(5)
    truth = dice.random(4000) < 0.7
    right = np.array([0.9, 0.85, 0.8, 0.55, 0.9])
    votes = np.where(dice.random((4000, 5)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    votes[dice.random((4000, 5)) < 0.2] = 0
    counts = Counter(map(tuple, votes.tolist()))
    model = quality_rules.fit(sorted(counts.items()))
    good = quality_rules.posterior(votes, model)
    assert ((good >= 0.5) == truth).mean() > 0.93
    assert model["table"][1, 3, 2] < model["table"][1, 0, 2]
    assert abs(model["share"] - truth.mean()) < 0.06


def plain_pii(text):
    text = text or ""

    def luhn(s):
        d = [int(c) for c in s if c.isdigit()][::-1]
        return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])

    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(re.sub(r"\D", "", m[0])) <= 19 and luhn(m[0]) % 10 == 0]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    order = ["email", "ip", "card", "phone"]
    return sorted(((k, m.start(), m.end()) for k, m in out), key=lambda s: (s[1], order.index(s[0])))


def test_pii(spark, odd):
    for path in folders(odd):
        wanted = []
        for doc, text in texts(spark, path):
            spans = plain_pii(text)
            sha = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
            wanted.append({"doc_id": doc, "base_sha256": sha, **{f"n_{k}": sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")}})
        same(rows(spark, "op10_pii", path, "doc_id"), wanted)


@pytest.mark.parametrize("text", ["a@b.c@d.e.f", "@@a@b..c", "1.2.3.4.5.6.7.8", "256.1.1.1", "1.2.3.00000255", "+1 2+33 44 55 66 77", "4111-1111 1111-1111-", "x@y.z" * 3, "9" * 40, "a+b@c.d-e.f.", "é@ü.de a_%@b-.c"])
def test_pii_patterns_on_hard_texts(text):
    assert [(pii.BASE_KINDS[k], a, b) for a, b, k in pii.base_spans(text)] == plain_pii(text)


@pytest.fixture(scope="session")
def field():
    return pii.train()


def test_field_learns_and_viterbi_is_exact(field):
    import itertools

    import numpy as np

    right = total = 0
    for _, words, tags in pii.labelled_table(9)[-60:]:
        scores, n = _scores(field, words), len(words)
        got = field.decode(scores, np.array([0]), np.array([n]))
        right += sum(field.labels[g] == t for g, t in zip(got, tags))
        total += n
        if n <= 6:
            best = max(itertools.product(range(len(field.labels)), repeat=n), key=lambda y: field.start[y[0]] + sum(scores[i, y[i]] for i in range(n)) + sum(field.step[a, b] for a, b in zip(y, y[1:])))
            assert list(best) == got.tolist()
    assert right / total > 0.97


def _scores(field, words):
    import numpy as np

    return field.emissions(field.classes(words), np.zeros(len(words), dtype=np.int64))


def plain_field_spans(field, text):
    """Plain Viterbi over each whole line, word by word."""
    out, at = [], 0
    for line in text.split("\n"):
        words = [(m[0], at + m.start(), at + m.end()) for m in re.finditer(r"\S+", line)]
        at += len(line) + 1
        if not words:
            continue
        scores, n = _scores(field, [w for w, _, _ in words]).astype(float), len(field.labels)
        best, ways = scores[0] + field.start, []
        for row in scores[1:]:
            way = best[:, None] + field.step
            ways.append(way.argmax(axis=0))
            best = way.max(axis=0) + row
        path = [int(best.argmax())]
        for way in reversed(ways):
            path.append(int(way[path[-1]]))
        before = "O"
        for (_, a, b), k in zip(words, reversed(path)):
            label = field.labels[k]
            if label[0] == "I" and before[2:] == label[2:]:
                out[-1][1] = b
            elif label != "O":
                out.append([a, b, label[2:]])
            before = label
    return [pii._trim(text, *s) for s in out]


def test_spans_equal_plain_viterbi(spark, odd, field):
    """The whole spans column: base spans, and those of a plain decoding that overlap none of them."""
    order, many = ["email", "ip", "card", "phone"], 0
    for path in ["/root/testdata/sf0.01", odd]:
        found = Counter((r["doc_id"], r["spans"]) for r in queries()["op10_pii"](spark, path).collect())
        wanted = Counter()
        for doc, text in texts(spark, path):
            base = plain_pii(text)
            more = [(k, a, b) for a, b, k in plain_field_spans(field, text or "") if all(b <= x or a >= y for _, x, y in base)]
            many += len(more)
            both = sorted(base + more, key=lambda s: (s[1], order.index(s[0]) if s in base else order.index(s[0]) if s[0] in order else 4, s[0]))
            wanted[doc, ",".join(f"{k}:{a}:{b}" for k, a, b in both)] += 1
        assert found == wanted
    assert many > 1


def test_field_has_no_longest_entity_or_line(field):
    def found(text):
        return [(text[a:b], k) for a, b, k in field.spans(text)]

    assert found("my iban: DE89 3704 0044 0532 0130 00 was") == [("DE89 3704 0044 0532 0130 00", "account")]
    assert found("my name is Juan Carlos Alberto Maria Gomez Ruiz and the end") == [("Juan Carlos Alberto Maria Gomez Ruiz", "name")]
    assert found("my name is Maria Lopez and lorem the ontion") == [("Maria Lopez", "name")]
    assert found("contact Anna Weber, Peter Hansen, Li Wei and us") == [("Anna Weber", "name"), ("Peter Hansen", "name"), ("Li Wei", "name")]
    for before in range(55, 70):
        assert found("lorem " * before + "contact Anna Weber") == [("Anna Weber", "name")]
    assert found("lorem ontion " * 300_000 + "contact Anna Weber")[-1] == ("Anna Weber", "name")
    assert found("To Mr. " * 20_000)  # a line with nothing settled is decoded whole


def test_field_over_the_documents(field):
    """Secrets planted in the documents (forty hexadecimal digits after a cue) against the field: recall and precision."""
    import duckdb

    gold = hit = more = 0
    rows_ = duckdb.sql("select text from read_parquet('/root/testdata/sf0.01/documents.parquet') where text is not null").fetchall()
    for (text,), spans in zip(rows_, field.spans_of([t for t, in rows_])):
        own = {m.span(1) for m in re.finditer(r"\btoken = \"([0-9a-f]{40})\"", text, re.I)}
        got = {(a, b) for a, b, k in spans if k == "secret"}
        gold, hit, more = gold + len(own), hit + len(own & got), more + len(got - own)
    assert gold > 10 and hit == gold and more <= gold // 10


def test_field_on_new_sentences(field):
    got = {k for _, _, k in field.spans("please write to Mr. Peter Hansen or call 0171 5559876")}
    assert got == {"name", "phone"}
    assert field.spans("The rains came late. Nothing grew. Old men sat by the road.") == []
    text = "token = \"0f3b1c2d4e5f60718293a4b5c6d7e8f901234567\" ok"
    (a, b, kind) = field.spans(text)[0]
    assert kind == "secret" and text[a:b] == "0f3b1c2d4e5f60718293a4b5c6d7e8f901234567"


def test_redaction_keeps_rows_and_columns(spark, odd, field):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = pii.redact(docs, field)
    assert out.schema == docs.schema and out.count() == docs.count()
    text = {r["doc_id"]: r["text"] for r in out.collect()}[8]
    assert text == "mail [EMAIL] or [IP], [CARD], [PHONE] ok"


def test_toxicity_on_held_out_rows(spark):
    path = "/root/testdata/sf0.1"
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    found = [r for r in rows(spark, "op4_toxicity", path, "doc_id")]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    judged = [(label[r["doc_id"]], r["predicted"]) for r in found if r["held_out"] and r["doc_id"] in label]
    assert sum(a == b for a, b in judged) / len(judged) > 0.95
    assert sum(b for a, b in judged if a == 0) / sum(a == 0 for a, _ in judged) < 0.01
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)


def test_counterfactual_penalty_spares_neutral_mentions():
    """Abuse in the training rows often names one group; with the penalty the name alone doesn't count."""
    plain = ["the {} went home early", "many {} live in this town", "a school for {} opened"]
    foul = ["those {} are vile scum", "i hate {} vile people", "{} are scum"]
    rows_ = [(toxicity.words_of(t.format("muslims")), 1) for t in foul] * 6 + [(toxicity.words_of(t.format("people")), 0) for t in plain] * 6
    rows_ += [(toxicity.words_of("vile scum everywhere"), 1)] * 2
    names = sorted({f for s, _ in rows_ for x in toxicity.counterfactual(s) for w in x for f in toxicity.features(w)})
    index = {f: i for i, f in enumerate(names)}

    def number(words):
        return sorted({index[f] for w in words for f in toxicity.features(w) if f in index})

    data = [(number(s), tuple(map(number, toxicity.counterfactual(s))), y, 1.0) for s, y in rows_]
    neutral = "the muslims went home early"
    biased, fair = toxicity.fit(data, names, penalty=0.0), toxicity.fit(data, names, penalty=10.0)
    assert fair.score(neutral) < biased.score(neutral)
    assert abs(fair.logit(toxicity.words_of(neutral)) - fair.logit(toxicity.words_of("the hindus went home early"))) < abs(
        biased.logit(toxicity.words_of(neutral)) - biased.logit(toxicity.words_of("the hindus went home early"))
    )
    assert fair.score("those muslims are vile scum") > 0.7


NEUTRAL = ["many {} live in this town", "the {} went home early", "a school for {} opened here", "{}", "she met two {} at the market"]


def mentions(model):
    """Over neutral sentences: the mean change of the logit under swaps within families, by a mention, and the highest score."""
    swaps, added, top = [], [], 0.0
    for sentence in NEUTRAL:
        bare = model.logit(toxicity.words_of(sentence.format("")))
        for family in toxicity.IDENTITY:
            own = [model.logit(toxicity.words_of(sentence.format(t))) for t in family]
            swaps += [abs(a - b) for a, b in zip(own, own[1:] + own[:1])]
            added += [abs(a - bare) for a in own]
            top = max(top, *(model.score(sentence.format(t)) for t in family))
    return sum(swaps) / len(swaps), sum(added) / len(added), top


def test_trained_model_treats_groups_alike(spark):
    """The model of the query itself, with its penalty and without: swapped twins score alike, and no neutral mention is
    flagged."""
    path = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    swap, added, top = mentions(toxicity.train(docs, labels))
    swap0, added0, _ = mentions(toxicity.train(docs, labels, penalty=0.0))
    print("logit change, with and without penalty: swap", swap, swap0, "mention", added, added0, "highest score", top)
    assert swap0 > 0.05 and swap < 0.2 * swap0 and added < 0.2 * added0
    assert top < 0.5


def test_repeated_ids_do_not_multiply_the_sample(spark):
    """One text for each id is learned from, however many rows share it."""
    docs = [(i, ("vile scum everywhere " if i % 2 else "a fine day out ") + f"w{i}") for i in range(60)]
    rows_ = docs + [(i, "other words under this id") for i in range(60)] * 5
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(rows_, "doc_id long, text string"), labels, sample_rows=40)
    assert 0 <= model.score("vile scum") <= 1
    plain = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), labels, sample_rows=40)
    assert plain.score("vile scum everywhere") > 0.7 > plain.score("a fine day out")


def test_scores_equal_plain_sums(spark, odd):
    """Brute force of the digest: features counted out, weights summed, for every text."""
    import math

    for path in folders(odd):
        docs = spark.read.parquet(f"{path}/documents.parquet")
        model = toxicity.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
        wanted = Counter()
        for doc, text in texts(spark, path):
            words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
            found = {w for w in words} | {w[:k] + "~" for w in words for k in range(3, 7) if k < len(w)}
            score = 1 / (1 + math.exp(-max(-40.0, min(40.0, model.bias + math.fsum(model.weights.get(f, 0.0) for f in found)))))
            out = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 1
            wanted[doc, out, round(score, 9), int(score >= 0.7)] += 1
        got = Counter((r["doc_id"], r["held_out"], round(r["score"], 9), r["predicted"]) for r in rows(spark, "op4_toxicity", path, "doc_id"))
        assert got == wanted


def test_toxicity_on_odd_rows(spark, odd):
    found = rows(spark, "op4_toxicity", odd, "doc_id")
    assert len(found) == len(texts(spark, odd)) and all(r["score"] is not None for r in found)


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """Two texts of two megabytes, near copies of each other (one line, and many lines), and a long page."""
    path = str(tmp_path_factory.mktemp("long"))
    words = [f"w{i % 9973}x{i % 641}" for i in range(200_000)]
    other = [*words[:100_000], "mail a.b@c.example.org MIT licence", *words[100_000:]]
    rows_ = [(1, " ".join(words)), (2, "\n".join(" ".join(other[i : i + 12]) for i in range(0, len(other), 12))), (3, "short text")]
    spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows_], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(words[500:540]))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    html = "<table>" + "".join(f"<tr><td>{w}<td>b" for w in words[:40_000]) + "</table>"
    spark.createDataFrame([(1, "http://a/", html)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


def test_texts_of_megabytes(spark, long_texts):
    got = {n: q(spark, long_texts).collect() for n, q in queries().items() if n != "op2_warc_fixity"}
    assert sorted((r["doc_id"], r["class_id"]) for r in got["op7_simhash_dedup"]) == [(1, 1), (2, 1), (3, 3)]
    assert {(r["doc_id"], r["item_id"]) for r in got["op3_decontamination"]} == {(1, 1), (2, 1)}
    removed = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in got["op5_substring_dedup"]}
    assert removed == {1: (200_000, 0), 2: (200_004, 200_000), 3: (2, 0)}
    assert {r["doc_id"]: r["labels"] for r in got["op6_license_scan"]} == {1: "", 2: "mit", 3: ""}
    assert {r["doc_id"]: r["n_email"] for r in got["op10_pii"]} == {1: 0, 2: 1, 3: 0}
    assert {r["doc_id"]: r["n_words"] for r in got["op9_quality_rules"]} == {1: 200_000, 2: 200_004, 3: 2}
    assert len(got["op4_toxicity"]) == 3 and got["op8_html_render"][0]["n_lines"] == 40_000
    pieces = [r for r in got["op1_packing"] if r["doc_id"] == 1]
    assert sum(r["length"] for r in pieces) == pieces[0]["doc_tokens"]


ODD_WORDS = (
    "To to Mr. mr Dr name is Anna Weber, call tel: +49 171 5559876 key; Key? BY by. (to) 'at' Frau herr, iban: DE89 3704 token = "
    '"0f3b1c2d4e5f60718293a4b5c6d7e8f901234567" lorem ipsum, dolor. ª º A É éa Éa. ß µ x! | a|b ² ½ ٣ œuvre Œ İ ŉ 😀 z.. , a. A.'
).split() + ["z" * 19, "z" * 20, "z" * 25 + ".", "Z" * 3, "\x85", "\xa0", "\x1c", "　", "\x0b", "\n", "\n\n", "  "]


def _odd_texts(seed, words, rounds):
    import random

    dice = random.Random(seed)
    for _ in range(rounds):
        yield ["".join(dice.choice(words) + dice.choice([" ", " ", " ", "\n", ""]) for _ in range(dice.randrange(40))) for _ in range(dice.randrange(4))]


def test_words_classed_by_form_as_one_by_one(field):
    for made in _odd_texts(5, ODD_WORDS, 300):
        flat = pii.Flat(made)
        words = [flat.joined[a:b] for a, b in zip(flat.begins, flat.ends)]
        assert words == [w for t in made for line in t.split("\n") for w in line.split()]
        assert field.flat_classes(flat).tolist() == field.classes(words).tolist()
        assert field.spans_of(made) == [[tuple(s) for s in plain_field_spans(field, t)] for t in made]


def test_plain_words_are_not_looked_at_one_by_one(field, monkeypatch):
    """Time of personal data in the pipeline: new plain words cost no call each (before: one each)."""
    import itertools
    import pickle

    seen, plain = [], pii.features
    monkeypatch.setattr(pii, "features", lambda w: seen.append(w) or plain(w))
    words = ["".join(x) + end for x, end in zip(itertools.product("abcdefgh", repeat=5), itertools.cycle(["", ",", ".", ""]))]
    new = pickle.loads(pickle.dumps(field))
    assert new.spans_of([" ".join(words[:10_000]), "Then " + "\nMore ".join(words[10_000:])]) == [[], []]
    assert len(seen) < 100


def test_texts_scored_together_as_one_by_one(monkeypatch):
    """Time of toxicity in the pipeline: texts are scored by flat arrays, with the very scores of single texts."""
    weights = {f: (-1) ** i * 0.1 * (i % 7 + 1) for i, f in enumerate(sorted({f for w in ODD_WORDS for f in toxicity.features(w.lower())}))}
    weights |= {"schönes": 0.3, "schönesten": -0.7, "schöne~": 0.2, "sch~": 0.05, "œuvres": 1.0, "ingeshe": -0.4}
    model = toxicity.Model(weights, -0.3)
    words = [*ODD_WORDS, "Schönes", "schönesten", "schönest", "œuvres", "ingeshe", "Ingesheim", "\0", "_", "9"]
    for made in [[], [None], ["", None], *_odd_texts(6, words, 300)]:
        assert model.scores(made) == [model.score(t) for t in made]
    assert toxicity.Model({}, 0.0).scores(["a b", None]) == [0.5, 0.5]
    monkeypatch.setattr(toxicity, "words_of", None)
    assert len(model.scores([f"plain {i} schön" for i in range(5000)])) == 5000
