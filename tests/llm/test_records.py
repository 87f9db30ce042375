"""Corpus operators held against brute force, exact round trips and edge cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from refold.llm import chat, common, decontamination, licenses, packing, pii, quality_rules, queries, simhash, token_files, token_rollups, tokens, warc

SF = "/root/testdata/sf0.001"
WORD, BYTE = queries.tokenizer_path(queries.WORD_BPE), queries.tokenizer_path(queries.BYTE_BPE)
ODD = [None, "", " ", "\n\n", "a", "a b", "é́ ß", "x" * 30_000, "word " * 9_000, "​　\x85", "İ. ab, ABC", "<|endoftext|> a", "the the the the", "1.2.3.4 a@b.c"]


def documents(spark, texts, extra=True):
    """doc_ids with ties and a null, and columns whose names clash with those that operators make."""
    rows = [(k if k != 3 else None, t, "src0", "en", 7, "mine", k) for k, t in enumerate(texts)]
    rows += rows[:2]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, piece string, start int")
    return df if extra else df.select("doc_id", "text", "source", "lang", "n_chars")


def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# ---------------------------------------------------------------- tokens


def library(path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_equal_the_library_on_whole_texts(path):
    r = random.Random(5)
    alphabet = ["a", "B", " ", " ", "\n", "\t", "\xa0", "é", "é", "'s", "'", "1", "２", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "\x1c", "\x85", "ß", "İ", "Σ", "中", "😀", ".", ",", "\r", "​", "　", "क़"]
    texts = [*ODD, *("".join(r.choice(alphabet) for _ in range(r.randrange(14))) for _ in range(20_000))]
    enc, brute = tokens.Encoder(path), library(path)
    ids, at = enc.column(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == brute(t), repr(t)


def test_memo_may_start_afresh(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 3)
    enc, brute = tokens.Encoder(WORD), library(WORD)
    for text in ("one two three four", "five, six. one"):
        assert enc.column(pa.array([text]))[0].tolist() == brute(text)


# ---------------------------------------------------------------- packing


def best_fit(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [(b, k) for k, b in enumerate(left) if b >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(capacity - n)
    return sorted(left)


def test_plan_is_best_fit_decreasing():
    for seed in range(150):
        r = random.Random(seed)
        capacity = r.choice([7, 16, 50, 100])
        items = [r.randrange(1, capacity + 1) for _ in range(r.randrange(150))]
        counts = collections.Counter(items)
        runs, bins = packing.plan(counts, capacity), collections.defaultdict(list)
        for n in counts:
            own = [x for x in runs if x[0] == n]
            for rank in range(counts[n]):
                _, first, each, b, offset = [x for x in own if x[1] <= rank][-1]
                bins[b + (rank - first) // each].append((offset + (rank - first) % each * n, n))
        for placed in bins.values():
            at = 0
            for offset, n in sorted(placed):
                assert offset == at
                at += n
        assert sorted(capacity - sum(n for _, n in p) for p in bins.values()) == best_fit(items, capacity)


def check_packed(rows, texts, capacity=4096):
    brute, want = library(WORD), collections.Counter()
    for doc, t in texts:
        ids = np.array([*brute(t), 1], "<u4")
        for p, s in enumerate(range(0, len(ids), capacity)):
            want[doc, p, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in p) for p in bins.values()) == best_fit([r.length for r in rows], capacity)


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 3)
    docs = documents(spark, ODD)
    check_packed(packing.pack_documents(docs, WORD).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    check_packed(queries.op3_packing(spark, SF).collect(), [(r.doc_id, r.text) for r in real(spark).collect()])
    assert packing.pack_documents(docs.where("false"), WORD).count() == 0


# ---------------------------------------------------------------- token files


def test_token_files_round_trip(spark, tmp_path):
    for name, docs in (("odd", documents(spark, ODD)), ("real", real(spark)), ("none", real(spark).where("false"))):
        path = f"file://{tmp_path}/{name}"
        files = token_files.write(docs, path, BYTE, length=64, rows=4)
        got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_documents(spark, path, files).collect()))
        brute, want = library(BYTE), collections.Counter()
        rows = docs.collect()
        for r in rows:
            ids = np.array([*brute(r.text), 0], "<u4")
            want[r.doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
        assert collections.Counter((d, n, c) for _, d, n, c in got) == want
        at, last = 0, -(1 << 63)
        for start, doc, n, _ in got:
            key = -(1 << 62) if doc is None else doc
            assert start == at and key >= last
            at, last = at + n, key
        for f in files:  # any sequence is reached alone, and the masks count the ids
            batches = token_files.batches_of(path, f.part)
            assert sum(int(token_files.sequence(batches, k)[1].sum()) for k in range(f.n_sequences)) == f.n_tokens
            assert all(b.column("ids").type.list_size == 64 for b in batches)
            if f.n_sequences:
                assert token_files.sequence(batches, f.n_sequences - 1)[0].flags.owndata is False


# ---------------------------------------------------------------- rollups


def test_rollups_are_idempotent_and_follow_changes(spark, tmp_path):
    docs = documents(spark, ODD)
    rows = common.settle(token_rollups.counted(docs, {"w": WORD}), "t")
    book = token_rollups.Rollups(spark, f"file://{tmp_path}/book")
    assert book.totals().count() == 0
    assert book.commit("a", token_rollups.inserts(rows)) and not book.commit("a", token_rollups.inserts(rows))
    brute = library(WORD)
    n = sum(len(brute(r.text)) for r in docs.collect())
    r = book.totals().first()
    assert (r.n_docs, r.n_tokens) == (len(ODD) + 2, n)
    revised = rows.select(*token_rollups.KEYS, F.col("tokens").alias("tokens_before"), (F.col("tokens") * 2).alias("tokens_after"))
    assert book.commit("b", revised) and book.totals().first().n_tokens == 2 * n
    assert book.commit("empty", revised.where("false"))
    assert book.commit("c", token_rollups.deletes(rows.withColumn("tokens", F.col("tokens") * 2))) and book.totals().count() == 0
    assert book.batches() == ["a", "b", "c", "empty"]
    with pytest.raises(ValueError, match="batch id"):
        book.commit("../x", revised)


def test_rollup_query(spark):
    brute = {v: library(queries.tokenizer_path(v)) for v in (queries.WORD_BPE, queries.BYTE_BPE)}
    want = collections.Counter()
    for r in real(spark).collect():
        for v, name in ((queries.WORD_BPE, queries.WORD_BPE), (queries.BYTE_BPE, queries.BYTE_BPE + "+end")):
            want[r.source, r.lang, name, "docs"] += 1
            want[r.source, r.lang, name, "tokens"] += len(brute[v](r.text)) + 1
    got = collections.Counter()
    for r in queries.op5_token_rollups(spark, SF).collect():
        got[r.source, r.lang, r.tokenizer, "docs"], got[r.source, r.lang, r.tokenizer, "tokens"] = r.n_docs, r.n_tokens
    assert got == want


# ---------------------------------------------------------------- quality rules


def measured(t):
    t = t or ""
    w, lines = words(t), [x for x in t.split("\n") if words(x)]
    seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {p for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", "".join(w))), len(lines) - len(set(lines)), len(covered)


def test_ledger(spark):
    for docs in (documents(spark, [*ODD, "a b c a b c a b c", "x\ny\nx\n \n ", "# | <a> " * 60]), real(spark)):
        rows, texts = quality_rules.ledger(docs).collect(), collections.Counter((r.doc_id, *measured(r.text)) for r in docs.collect())
        assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == texts
        kept = quality_rules.keep(docs)
        assert kept.columns == docs.columns
        assert kept.count() == sum(r.fail_bits & quality_rules.policy_mask("corpus-1") == 0 for r in rows)
        for r in rows:
            assert bool(r.fail_bits & 3) == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        by_rule = {a.rule: a for a in quality_rules.ablations(quality_rules.ledger(docs)).collect()}
        for rule in quality_rules.RULES if rows else ():
            bit = 1 << rule.bit
            a = by_rule[rule.name]
            assert (a.failed, a.failed_alone, a.rejected_without) == (sum(bool(r.fail_bits & bit) for r in rows), sum(r.fail_bits == bit for r in rows), sum(bool(r.fail_bits & ~bit) for r in rows))
    assert quality_rules.ledger(real(spark).where("false")).count() == 0


# ---------------------------------------------------------------- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(c if k % 2 == 0 else 2 * c - 9 * (c > 4) for k, c in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(t):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans(spark):
    r = random.Random(11)
    alphabet = ["1", "22", "333", ".", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "é", "😀", "4111 1111 1111 1111", "+1 (017) 555-7713", "10.0.0.255", "x@y.z", "\n"]
    odd = ["".join(r.choice(alphabet) for _ in range(r.randrange(25))) for _ in range(3000)]
    docs = documents(spark, [*ODD, "a." * 20_000 + "@b.c", "9" * 40_000, "+1" * 9_000, *odd])
    for df in (docs, real(spark)):
        texts = collections.Counter()
        for d in df.collect():
            spans = base_spans(d.text)
            n = collections.Counter(s.split(":")[0] for s in spans)
            texts[d.doc_id, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(spans).encode()).hexdigest()] += 1
        rows = pii.report(df).collect()
        assert collections.Counter((x.doc_id, x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256) for x in rows) == texts


def test_the_trees_add_spans_and_redaction_takes_them_out(spark):
    texts = ["pay 7536784127813050 4845168114407329 now", "call (017) 555-7713 or bob (at) example dot com, bob(at)example.com", "it cost 1234 567 8901 or 12.5.2020 v1.2.3", "clean prose of many words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.report(df).collect()}
    assert found[0].n_card == 0 and found[0].spans == "card:21:37" or found[0].spans == "card:4:20,card:21:37"
    assert "phone:5:19" in found[1].spans and found[1].n_phone == 0
    assert found[2].spans == found[3].spans == ""
    for r in pii.redact(documents(spark, [*texts, *ODD])).collect():
        assert r.text is None or not base_spans(r.text)
    assert pii.redact(documents(spark, ODD)).columns == documents(spark, ODD).columns
    assert pii.report(df.where("false")).count() == 0


def test_trees_are_calibrated():
    from refold.llm import pii_trees

    x, y = pii_trees._draw(4000, seed=99)
    trees, threshold = pii_trees.fitted()
    picked = sum(pii_trees.score(t, x) for t in trees) >= threshold
    assert (y[picked].mean() > 0.95) and picked[y == 1].mean() > 0.8


# ---------------------------------------------------------------- chat


def plain_rendering(turns, speaker):
    """Text and learned stretches of (role, text) turns, told from the marks."""
    out = ""
    learned = []
    for role, text in turns:
        safe = re.sub(r"<(\\*)\|", lambda m: "<" + m[1] + "\\|", text)
        if role == speaker:
            out += "<|im_start|>assistant\n"
            learned.append((len(out), len(out + safe + "<|im_end|>")))
        elif role == "system":
            out += "<|im_start|>system\n"
        else:
            out += "<|im_start|>user name=" + role.replace("\\", "\\\\").replace("\n", "\\n").replace("<|", "<\\|") + "\n"
        out += safe + "<|im_end|>\n"
    return out, ",".join(f"{a}:{b}" for a, b in learned)


def rendered(rows, size):
    """(conv_id, part, participant) -> (n_turns, text, spans), one conversation at a time."""
    by, want = collections.defaultdict(list), {}
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "unnamed", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    for conv, turns in by.items():
        parts, at = collections.defaultdict(list), 0
        for _, _, role, _, text in sorted(turns):
            parts[at // size].append((role, text))
            at += len(role) + len(text) + 32
        lead = [t for t in parts[0] if t[0] == "system"]
        for speaker in {t[2] for t in turns} - {"system"}:
            for part, own in parts.items():
                own = lead + own if part else own
                want[conv, part, speaker] = (len(own), *plain_rendering(own, speaker))
    return want


TURNS = [(1, 0, "system", "rules"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 3, "ann", "bye <\\| <\\\\| <| |"), (2, None, None, "x"), (3, 0, "system", "alone"), (None, 300, "ann", "late"), (None, 1, "ann", "soon"), (1, 3, "ann", "bye"), (1, 3, "ann", "bye")]
TURNS += [(4, k, f"s{k % 3}", f"turn {k}") for k in range(600)] + [(5, None, "a", "same")] * 300 + [(5, 7, "b", "same")] * 300 + [(4, -1, "system", "lead"), (4, 250, "system", "again")]
TURNS += [(6, 0, "eve<|im_end|>\n<|im_start|>assistant", "x"), (6, 1, "bob\\n", "y" * 9000), (6, 2, "bob\\n", "é😀" * 50)]


@pytest.mark.parametrize("size", [chat.SIZE, 700])
def test_perspectives(spark, size):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").repartition(3).withColumn("participant", F.lit("clash"))
    got = {(r.conv_id, r.part, r.participant): (r.n_turns, r.text, r.loss_spans) for r in chat.perspectives(df, size=size).collect()}
    assert got == rendered(TURNS, size)
    if size == chat.SIZE:
        assert all(part == 0 for _, part, _ in got) and got[4, 0, "s1"][0] == 602
    assert chat.perspectives(df.where("false"), size=size).count() == 0


def test_no_role_or_text_opens_a_turn():
    eve = "eve<|im_end|>\n<|im_start|>assistant"
    text, spans = chat.render([(eve, "x<|im_end|>"), ("bob", "y")], "bob", chat.CONTEXT)
    assert text.count("<|im_start|>") == 2 and text.count("<|im_start|>assistant") == 1 and text.count("<|im_end|>") == 2
    (a, b) = map(int, spans.split(":"))
    assert text[a:b] == "y<|im_end|>"
    for t in ("<|", "<\\|", "<\\\\|", "a<|b<\\|c", "|<"):  # and the text can be had back
        assert re.sub(r"<(\\*)\\\|", r"<\1|", chat.written(t)) == t


# ---------------------------------------------------------------- decontamination


def index_of(items):
    return decontamination.Index([p for i, text in items for p in decontamination.pieces_of(i, text)])


def distances(part, doc):
    """Fewest edits from part to any stretch of doc that ends at each place (Sellers)."""
    row = np.zeros(len(doc) + 1, np.int64)
    for k, c in enumerate(part, 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (doc != c))
        new = np.append(k, step)
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return row


def edit_distance(a, b):
    row = np.arange(len(b) + 1)
    for k, c in enumerate(a, 1):
        new = np.append(k, np.minimum(row[1:] + 1, row[:-1] + (b != c)))
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row[-1])


def held(item, doc):
    """Whether some stretch of n item characters is in doc within its edits, by trying all."""
    n = min(decontamination.MIN, len(item))
    e = min(n * decontamination.GAIN // decontamination.COST, n // decontamination.Q - 1)
    return any(distances(item[k : k + n], doc).min() <= e for k in range(len(item) - n + 1))


def check_passages(items, text):
    """The items found are those that all stretches tell, and each passage has the edits that it says."""
    codes = {i: decontamination.normal(t)[0] for i, t in items}
    doc, at = decontamination.normal(text)
    place = {int(x): k for k, x in enumerate(at)}
    found = list(index_of(items).passages(text))
    assert {p[0] for p in found} == {i for i, c in codes.items() if len(c) >= decontamination.Q and held(c, doc)}
    for i, x, y, a, b, size, edits in found:
        assert size == len(codes[i]) and b - a >= min(decontamination.MIN, size)
        assert edit_distance(codes[i][a:b], doc[place[x] : place[y - 1] + 1]) == edits
    return found


def test_the_filter_loses_nothing(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(5).collect()] + [(900, "seven wizards"), (901, "Ｆour tea pots x")]
    texts = [r.text for r in real(spark).orderBy("doc_id").limit(30).collect()]
    r = random.Random(3)
    for _ in range(15):
        _, item = r.choice(items)
        w = list(item)
        for _ in range(int(len(w) * r.random() * 0.14)):
            w[r.randrange(len(w))] = r.choice("abcdefgh")
        a, b = sorted(r.sample(range(len(w) + 1), 2))
        check_passages(items, r.choice(texts)[:200] + " " + "".join(w[a:b]).upper() + "\n" + r.choice(texts)[:60])


def test_every_passage_of_an_item_is_found():
    r = random.Random(9)
    item = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200))
    found = check_passages([(1, item)], f"1{item}2{item}3{item[50:130]}4{item}")
    assert sorted(p[1:5] for p in found) == [(1, 201, 0, 200), (202, 402, 0, 200), (403, 483, 50, 130), (484, 684, 0, 200)]


def test_long_and_repetitive_texts(monkeypatch):
    r = random.Random(10)
    item = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200))
    noise = "".join(r.choice("0123456789 ") for _ in range(1_200_000))
    assert list(index_of([(1, item)]).passages(noise + "." + item)) == [(1, 1_200_001, 1_200_201, 0, 200, 200, 0)]
    monkeypatch.setattr(decontamination, "LIMIT", 20_000)
    again = "abc def ghi " * 80
    found = check_passages([(1, item), (2, "abc def ghi " * 8), (3, "def ghi abc " * 7)], again + item + " " + again)
    assert [p for p in found if p[0] == 1] == [(1, 960, 1160, 0, 200, 200, 0)]
    for i in (2, 3):  # the repeats are covered, and no two passages of an item overlap
        spans = sorted(p[1:3] for p in found if p[0] == i)
        assert all(x[1] <= y[0] for x, y in itertools.pairwise(spans)) and sum(y - x for x, y in spans) > 1700


def test_long_items_are_looked_up_in_pieces(monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE", 150)
    r = random.Random(11)
    item = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1000))
    for a in range(0, 950, 37):  # any stretch lies in a piece
        assert (4, 1, 49, a, a + 48, 1000, 0) in list(index_of([(4, item)]).passages("1" + item[a : a + 48] + "2"))
    covered = set()
    for p in index_of([(4, item)]).passages("1" + item + "2"):
        covered |= set(range(p[1], p[2]))
    assert covered == set(range(1, 1001))


def test_excerpts_within_the_budget_are_found():
    """48 characters with 3 edits, between others that are not the item's, count even if a clean part scores more."""
    r, n = random.Random(6), decontamination.MIN
    for _ in range(40):
        item = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(120))
        a = r.randrange(len(item) - n)
        w = list(item[a : a + n])
        for k in r.sample(range(n), 3):
            w[k] = r.choice("0123456789")
        text = "1" * 20 + "".join(w) + "2" * 20
        (found,) = index_of([(5, item)]).passages(text)
        assert found[0] == 5 and found[6] <= 3 and found[4] - found[3] >= n


def test_passages_and_clean(spark):
    item = "The quick brown fox jumps over the lazy dog while seven wizards brew strong tea, again and again."
    near = item.replace("wizards", "wizard").replace("brew", "brews").upper()
    texts = [*ODD, f"before. {item} after", f"x {near}\ny", item[:30], "nothing to see " * 40]
    docs = documents(spark, texts)
    items = spark.createDataFrame([(1, item), (2, None), (3, "short"), (4, item), (5, "")], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    rows = decontamination.passages(docs, items).collect()
    n = len(ODD)
    assert {(r.doc_id, r.item_id) for r in rows} == {(n, 1), (n, 4), (n + 1, 1), (n + 1, 4)}
    for r in rows:
        cut = texts[r.doc_id][r.doc_start : r.doc_end]
        assert cut[:9].lower() == "the quick" and (r.edits == 0) == (r.doc_id == n)
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert decontamination.passages(docs, items.where("false")).count() == 0 and decontamination.passages(docs.where("false"), items).count() == 0


def test_blocks_of_items(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    parts = decontamination.blocks(items, 2000)
    assert len(parts) > 2 and sum(len(p.value.ids) for p in parts) == items.count()
    assert all(sum(map(len, p.value.items)) < 2000 + decontamination.PIECE for p in parts)
    whole = sorted(map(tuple, queries.op6_decontamination(spark, SF).collect()))
    split = []
    for p in parts:
        split += map(tuple, real(spark).select("doc_id", "text").mapInArrow(decontamination._finder(p), decontamination.HITS).collect())
    assert sorted(split) == whole and whole


# ---------------------------------------------------------------- archives


def test_archives(spark, tmp_path):
    pages = [(1, "http://a/ b", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (None, "u", "x"), (5, "u", "é" * 5000), (5, "u", "é" * 5000), (6, "u", "one\r\n\r\ntwo"), (None, None, "lone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    for name, table in (("odd", df), ("real", spark.read.parquet(f"{SF}/pages.parquet")), ("none", df.where("false"))):
        path = f"file://{tmp_path}/{name}"
        files = warc.write(table, path)
        got = collections.Counter(tuple(r)[:5] for r in warc.records(spark, path, files).collect())
        rows, want = table.collect(), collections.Counter()
        canon = {}
        for r in rows:
            canon[r.html or ""] = max(canon.get(r.html or "", -1), -1 if r.page_id is None else r.page_id)
        for r in rows:
            body, first = (r.html or "").encode(), canon[r.html or ""]
            same = first == (-1 if r.page_id is None else r.page_id)
            want[r.page_id, len(body), warc.digest(body), "response" if same else "revisit", None if same else first] += 1
        assert got == want
        for f in files:  # a record is read from its offset alone
            spots = [r.offset for r in warc.records(spark, path, [f]).collect()]
            assert spots == sorted(set(spots))


def test_archive_without_training(tmp_path):
    import io

    out = io.BytesIO()
    w = warc.Writer(out)
    w.add(warc.record(1, "u", b"", None, False))
    w.close()
    out.seek(0)
    [(at, data)] = list(warc.read(out))
    assert at > 8 and warc.parse(data)[1:] == (b"", 0)


def test_small_payloads_are_all_responses(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x"), (2, "u", "x"), (3, "u", "xy"), (4, "u", "xy")], "page_id long, url string, html string")
    files = warc.write(df, f"file://{tmp_path}/w", least=2)
    assert sorted((r.page_id, r.record_type) for r in warc.records(spark, f"file://{tmp_path}/w", files).collect()) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]


# ---------------------------------------------------------------- near-duplicates


def brute_fingerprint(t):
    from xxhash import xxh64_intdigest

    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    codes, label = np.array(fps, np.uint64), list(range(len(fps)))

    def find(k):
        while label[k] != k:
            label[k] = label[label[k]]
            k = label[k]
        return k

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i] ^ codes[: i]) <= 2):
            a, b = find(i), find(int(j))
            label[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(fps))]


def test_components(spark):
    for df in (documents(spark, [*ODD, *ODD]), real(spark)):
        rows = sorted(df.collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id))
        fps = [brute_fingerprint(r.text) for r in rows]
        groups = brute_components(fps)
        least = {}
        for g, r in zip(groups, rows, strict=True):
            if r.doc_id is not None:
                least[g] = min(least.get(g, r.doc_id), r.doc_id)
        want = collections.Counter((r.doc_id, f, least.get(g)) for r, f, g in zip(rows, fps, groups, strict=True))
        got = collections.Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.cluster(df).collect())
        assert got == want
    assert simhash.cluster(real(spark).where("false")).count() == 0


def brute_groups(texts):
    """Groups of texts whose five-word shingles have a similarity of 0.8 or more."""
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in ((t or "").encode().lower().split() for t in texts)]
    label = list(range(len(sets)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(sets))]


def test_survivors(spark):
    """No document goes without a near copy that stays; nearly all near copies go."""
    r = random.Random(8)
    rows = real(spark).orderBy("doc_id").collect()
    long = [x.text for x in rows if len(words(x.text)) > 80][:12]
    near = []
    for t in long:
        w = t.split(" ")
        for _ in range(max(1, len(w) // 60)):
            w[r.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    texts = [*ODD, *(x.text for x in rows[:120]), *near, *(t.upper() for t in long[:3])]
    df = documents(spark, texts)
    kept = simhash.survivors(df)
    assert kept.columns == df.columns
    given = df.collect()
    left = collections.Counter(x.doc_id for x in kept.collect())
    groups = brute_groups([x.text for x in given])
    best = {}
    for g, x in zip(groups, given, strict=True):
        best.setdefault(g, set()).add(x.doc_id)
    assert all(any(d in left for d in ids) for ids in best.values())
    assert left.total() >= len(best) and left.total() - len(best) <= 2
    assert simhash.survivors(df.where("false")).count() == 0


def test_survivors_on_one_boilerplate(spark):
    """Near copies whose long words are all those of one boilerplate stand in the middle of its buckets."""
    r = random.Random(12)
    plate = "considerations notwithstanding responsibilities acknowledgements representations circumstances administration communications international"
    texts = []
    for _ in range(40):
        w = [f"{r.choice('abcdefgh')}{r.randrange(1000)}" for _ in range(200)]
        texts.append(f"{plate} {' '.join(w)}")
        w[60] = w[140] = "other"
        texts.append(f"{plate} {' '.join(w)}")
    r.shuffle(texts)
    df = documents(spark, texts)
    groups = brute_groups(texts)
    left = {x.doc_id for x in simhash.survivors(df).collect()}
    assert len(set(groups)) == 40 and len(left) == 40


def test_pairs_of_prefixes_are_all_similar_pairs(monkeypatch):
    """Against all pairs, in batches of any size, whatever shingles count as common."""
    r = random.Random(13)
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    sets = []
    for _ in range(25):
        base = [r.randrange(1 << 60) for _ in range(r.randrange(1, 60))]
        for _ in range(4):
            sets.append(np.unique(np.array([x if r.random() > 0.06 else r.randrange(1 << 60) for x in base] + [7, 8, 9][: r.randrange(4)], np.uint64)))
    roots = [k if k % 5 else 0 for k in range(len(sets))]
    want = {(i, j) for i in range(len(sets)) for j in range(i) if roots[i] != roots[j] and simhash.similarity(sets[i], sets[j]) >= simhash.SIMILARITY}
    for names in ([], [7, 9], sorted(int(x) for x in np.concatenate(sets[::3]))):
        common_ = np.unique(np.array(names, np.uint64)), np.ones(len(set(names)), np.int64)
        rows = sorted((int(h), len(s) << 32 | k, i, roots[i]) for i, s in enumerate(sets) for k, h in enumerate(simhash.prefix(s, common_)))
        for step in (1, 37, len(rows)):
            batches = [pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows[k : k + step], strict=True)], names=["sh", "at", "row", "root"]) for k in range(0, len(rows), step)]
            flat = lambda out: [p for b in out for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            got = set(flat(simhash._meeting(iter(batches))))
            assert want and want <= got
            taking = flat(simhash._partnered(iter(batches)))
            fewer = [(*x, roots[x[2]]) for x in taking]
            assert len(set(taking)) == len(taking) and set(fewer) <= set(rows)
            again = pa.record_batch([pa.array(c, pa.int64()) for c in zip(*sorted(fewer), strict=True)], names=["sh", "at", "row", "root"])
            assert set(flat(simhash._meeting(iter([again])))) == got
            monkeypatch.setattr(simhash, "MANY", 2)
            some = {(max(p), min(p)) for p in flat(simhash._drawn(0)(iter(batches)))}
            assert some and some <= got


def test_large_groups_are_connected_by_few_pairs(spark, monkeypatch):
    """Copies that differ from their model, and more from each other: far fewer pairs than all are checked."""
    r = random.Random(14)
    model, texts = [f"{r.choice('abcdefgh')}{r.randrange(1000)}" for _ in range(220)], []
    for _ in range(240):
        w = list(model)
        for _ in range(r.randrange(3, 7)):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        texts.append(" ".join(w))
    checked, check = [], simhash.check
    monkeypatch.setattr(simhash, "check", lambda pairs, t: checked.append(pairs.count()) or check(pairs, t))
    left = simhash.survivors(documents(spark, texts)).count()
    assert left == len(set(brute_groups(texts)))
    assert sum(checked) < 240 * 60


def test_similarity_is_checked():
    a = "one two three four five six seven eight nine ten"
    assert simhash.similarity(simhash.shingle_set(a), simhash.shingle_set(a.upper())) == 1
    assert simhash.similarity(simhash.shingle_set(a), simhash.shingle_set(a + " eleven")) == 6 / 7
    assert simhash.similarity(simhash.shingle_set(None), simhash.shingle_set(" ")) == 1


def test_dense_nodes_are_divided(spark, monkeypatch):
    """Small node limits send fingerprints through every level; the links' components stay those of all pairs."""
    r = np.random.default_rng(2)
    base = r.integers(-(2**63), 2**63 - 1, 12, dtype=np.int64).view(np.uint64)
    codes = np.unique(np.concatenate([[b ^ (np.uint64(1) << np.uint64(x)) ^ (np.uint64(1) << np.uint64(y)) for x, y in r.integers(0, 20, (40, 2))] for b in base] + [base]))
    monkeypatch.setattr(simhash, "NODE", 8)
    monkeypatch.setattr(simhash, "SHARE", 4)
    signed = codes.view(np.int64).tolist()
    df = spark.createDataFrame([(0, x) for x in signed], "kind int, fp long")
    # workers hold the module's own limit, so the driver's smaller one shows in the outsized nodes
    roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    groups = brute_components(codes.tolist())
    least = {}
    for g, x in zip(groups, signed, strict=True):
        least[g] = min(least.get(g, x), x)
    assert {x: roots.get(x, x) for x in signed} == {x: least[g] for g, x in zip(groups, signed, strict=True)}


def test_streamed_nodes_over_the_limit(monkeypatch):
    monkeypatch.setattr(simhash, "NODE", 4)
    fp = np.arange(20, dtype=np.int64)
    mask = np.array([1] * 3 + [2] * 9 + [3] * 2 + [4] * 6)
    rows = pa.record_batch([pa.array(np.zeros(20, np.int32)), pa.array(fp), pa.array(mask), pa.array(np.zeros(20, np.int64))], names=["kind", "fp", "mask", "bits"])
    for cuts in ([20], [1, 4, 5, 13, 20], list(range(1, 21))):
        over, at = [], 0
        parts = []
        for c in cuts:
            parts.append(rows.slice(at, c - at))
            at = c
        for b in simhash._search(iter(parts)):
            over += [x["a"] for x in b.to_pylist() if x["mask"] is not None]
        assert sorted(over) == [*range(3, 12), *range(14, 20)]


def test_near_pairs_are_all_pairs():
    r = np.random.default_rng(1)
    for _ in range(30):
        sizes = r.integers(1, 120, r.integers(1, 20))
        codes = []
        for z in sizes:
            x = r.integers(-(2**63), 2**63 - 1, max(1, z // 6), dtype=np.int64)[r.integers(0, max(1, z // 6), z)].view(np.uint64)
            for _ in range(3):
                x = x ^ np.where(r.random(z) < 0.5, np.uint64(1) << r.integers(0, 64, z).astype(np.uint64), np.uint64(0))
            codes.append(x[np.argsort(simhash.gray_rank(x))])
        flat = np.concatenate(codes)
        got = {(a, b) for i, j in simhash.near_pairs(flat, sizes) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a != b}
        want, at = set(), 0
        for c in codes:
            a, b = np.nonzero(np.triu(np.bitwise_count(c[:, None] ^ c[None]) <= 2, 1))
            want |= set(zip((a + at).tolist(), (b + at).tolist(), strict=True))
            at += len(c)
        assert got == want


# ---------------------------------------------------------------- licenses


def test_winnowing_meets_every_shared_run():
    r = random.Random(4)
    need = licenses.GRAM + licenses.WINDOW - 1
    for _ in range(300):
        common_run = [r.randrange(50) for _ in range(need)]
        make = lambda: np.array([r.randrange(-1, 50) for _ in range(r.randrange(12))] + common_run + [r.randrange(-1, 50) for _ in range(r.randrange(12))])
        a, b = (licenses.shingles(make()) for _ in range(2))
        assert {int(a[p]) for p in licenses.winnow(a)} & {int(b[p]) for p in licenses.winnow(b)}


def test_notices(spark):
    mit, gpl = licenses.TEMPLATES["MIT-notice"], licenses.TEMPLATES["GPL-3.0-notice"]
    texts = [*ODD, f"Foo. {mit}\nbar", gpl.upper().replace("PUBLIC", "PUBLICK"), f"{mit} {gpl} {mit}", "licensed by the state, version 2 of the bill", "İ " + mit]
    rows = licenses.scan(documents(spark, texts)).collect()
    n = len(ODD)
    found = collections.Counter((r.doc_id, r.license_id) for r in rows)
    assert found == {(n, "MIT-notice"): 1, (n + 1, "GPL-3.0-notice"): 1, (n + 2, "MIT-notice"): 2, (n + 2, "GPL-3.0-notice"): 1, (n + 4, "MIT-notice"): 1}
    for r in rows:
        assert texts[r.doc_id][r.span_start : r.span_end].lower()[:8] in ("released", "this wor") and 0.8 <= r.coverage <= 1
    assert licenses.scan(documents(spark, texts).where("false")).count() == 0
    with pytest.raises(ValueError, match="fewer"):
        licenses.Index({"x": "two words"})


def test_notices_that_follow_each_other():
    index, mit = licenses.Index(licenses.usual()), licenses.TEMPLATES["MIT-notice"]
    for n in (2, 10):
        text = f"{mit}\n" * n
        got = index.notices(text)
        assert [(f[0], text[f[1] : f[2]]) for f in got] == [("MIT-notice", mit[:-1])] * n
    for k in range(len(mit.split())):  # four of its five words
        w = mit.split()
        w[k] = "other"
        found = index.notices("see: " + " ".join(w) + " here")
        assert found == [] if k == 2 else [(f[0], f[4]) for f in found] == [("MIT-notice", 4)]


def test_whole_license_texts():
    """Whole texts with words changed, among other words: coverage and span are those of the words that are left."""
    index, r = licenses.Index(licenses.usual()), random.Random(14)
    for name in ("ISC", "BSD-3-Clause", "Apache-2.0"):
        w = licenses._WORD.findall((licenses.TEXTS / f"{name}.txt").read_text())
        for share in (0.0, 0.05, 0.12):
            changed = {k for k in range(3, len(w) - 3) if r.random() < share}
            body = " ".join("changed" if k in changed else x for k, x in enumerate(w))
            (found,) = [f for f in index.notices(f"Some words. {body}\nmore of them") if f[0] == name]
            assert abs(found[4] - (len(w) - len(changed))) <= 2 + len(w) // 100 and found[5] == len(w)
            assert (found[1], found[2]) == (12, 12 + len(body))
    assert index.notices("the words of the license and of the software " * 2000) == []


def brute_alignment(template, doc):
    """Best score of a local alignment, cell by cell."""
    best, old = 0, [0] * (len(doc) + 1)
    for x in template:
        new = [0]
        for j, y in enumerate(doc, 1):
            new.append(max(0, old[j - 1] + (2 if x == y else -1), old[j] - 1, new[-1] - 1))
        best, old = max(best, *new), new
    return best


def test_alignment_is_the_best_one():
    r = random.Random(15)
    for _ in range(300):
        template, doc = (np.array([r.randrange(4) for _ in range(r.randrange(1, 14))]) for _ in range(2))
        found, best = licenses.align(template, doc, -len(template), len(doc), 0, len(doc)), brute_alignment(template.tolist(), doc.tolist())
        assert (found is None) == (best == 0)
        if found:
            assert brute_alignment(template.tolist(), doc[found[0] : found[1]].tolist()) == best and found[2] <= found[1] - found[0]


def test_license_query_finds_every_line(spark):
    want = collections.Counter()
    for r in real(spark).collect():
        for name, line in licenses.TEMPLATES.items():
            want[r.doc_id, name] += (r.text or "").count(line)
    got = collections.Counter((r.doc_id, r.license_id) for r in queries.op10_licenses(spark, SF).collect())
    assert got == +want


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = {r.doc_id: r for r in real(spark).collect()}
    ledger = {r.doc_id: r.fail_bits for r in quality_rules.ledger(real(spark)).collect()}
    left = sorted(d for d in docs if ledger[d] == 0)
    staying = {r.doc_id for r in simhash.survivors(real(spark).where(F.col("doc_id").isin(left))).collect()}
    groups = brute_groups([docs[d].text for d in left])
    assert {d for k, d in enumerate(left) if groups[k] == k} <= staying
    left = [d for d in left if d in staying]
    index = index_of([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    left = [d for d in left if not list(index.passages(docs[d].text))]
    texts = {r.doc_id: r.text for r in pii.redact(real(spark).where(F.col("doc_id").isin(left))).collect()}
    assert all(not base_spans(t) for t in texts.values())
    check_packed(corpus_pipeline.run(spark, SF).collect(), list(texts.items()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, documents(spark, ODD), SF)
        assert out.columns == documents(spark, ODD).columns, name
        assert stage(spark, documents(spark, ODD).where("false"), SF).count() == 0
