"""Percentile sketches, splits, token ids, containers and residue."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinegrain.llm import packing as P
from kinegrain.llm import quantiles as Q
from kinegrain.llm import residue as R
from kinegrain.llm import splits as S
from kinegrain.llm import tokens as T

# ---- percentiles -----------------------------------------------------------------------------


@pytest.mark.parametrize("shape", ["random", "sorted", "reversed", "ties", "heavy"])
def test_rank_error_is_bounded(shape):
    rng = np.random.default_rng(1)
    n = 60_000
    x = {"random": rng.normal(size=n), "sorted": np.arange(n) * 1.0, "reversed": np.arange(n)[::-1] * 1.0, "ties": rng.integers(0, 5, n) * 1.0, "heavy": rng.pareto(0.5, n)}[shape]
    s = Q.Sketch(64)
    for part in np.array_split(x, 7):
        s.add(part)
    check(s, x)
    assert s.rank_error() <= n / (2 * 64) * math.log2(n / 64) + 2 ** math.ceil(math.log2(n / 64))


def check(s, x):
    assert s.n == len(x)
    qs = [0.0, 0.01, 0.3, 0.5, 0.77, 0.99, 1.0]
    order = np.sort(x)
    for q, v in zip(qs, s.quantiles(qs), strict=True):
        rank = max(1, math.ceil(q * len(x)))
        low, high = np.searchsorted(order, v, "left") + 1, np.searchsorted(order, v, "right")
        assert low - s.rank_error() <= rank <= high + s.rank_error()


def test_any_tree_of_merges():
    rng = np.random.default_rng(2)
    parts = [rng.exponential(size=rng.integers(0, 4000)) for _ in range(23)]
    for seed in range(4):
        sketches = []
        for p in parts:
            s = Q.Sketch(128)
            s.add(p)
            sketches.append(Q.Sketch.from_bytes(s.to_bytes()))
        r = random.Random(seed)
        while len(sketches) > 1:
            r.shuffle(sketches)
            a = sketches.pop()
            sketches[0].merge(a)
        check(sketches[0], np.concatenate(parts))
    empty = Q.Sketch(8)
    empty.merge(Q.Sketch.from_bytes(Q.Sketch(8).to_bytes()))
    assert empty.n == 0
    with pytest.raises(ValueError):
        empty.merge(Q.Sketch(16))


def test_small_groups_are_exact():
    s = Q.Sketch(100)
    s.add(np.array([5.0, 1.0, 3.0]))
    assert s.quantiles([0.01, 0.5, 0.67, 1.0]) == [1.0, 3.0, 5.0, 5.0] and s.rank_error() == 0


SEGMENTS = "segment_id bigint, label string, run_date date, duration double, extra int"


def test_percentiles_dont_depend_on_the_layout(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "a" if i % 3 else "b", float(x)) for i, x in enumerate(rng.gamma(2.0, 3.0, 30000))]
    df = spark.createDataFrame(rows, "id bigint, g string, v double")
    found = set()
    for n in (3, 8, 13):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        sketches = Q.sketch_groups(df.repartition(n), {"g": F.col("g")}, F.col("v"), "id", 64)
        found.add(tuple(sorted(tuple(r) for r in Q.percentiles(sketches, ["g"], [0.1, 0.5, 0.99]).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(found) == 1
    for g, n, *got, error in found.pop():
        own = np.sort([v for _, k, v in rows if k == g])
        assert n == len(own) and 0 < error < n / 10
        for q, v in zip((0.1, 0.5, 0.99), got, strict=True):
            assert abs(np.searchsorted(own, v) + 1 - np.ceil(q * n)) <= error


def test_durations(spark):
    d = dt.date(2025, 1, 1)
    rng = np.random.default_rng(3)
    hot = rng.normal(size=9000)
    rows = [(i, " Move" if i % 2 else "move ", d if i % 3 else dt.date(2025, 1, 2), float(v), 0) for i, v in enumerate(hot)]
    rows += rows[:500]
    rows += [(90001, "x", d, None, 0), (90002, "x", d, float("nan"), 0), (90003, None, None, 2.0, 0), (None, "y", d, 1.0, 0), (90004, "z", d, float("inf"), 0), (90005, "z", d, -1.0, 0)]
    days = Q.duration_sketches(spark.createDataFrame(rows, SEGMENTS).repartition(5), 256)
    got = {(r.label, r.run_date): r for r in Q.percentiles(days, ["label", "run_date"], [0.5]).collect()}
    assert set(got) == {("move", d), ("move", dt.date(2025, 1, 2)), (None, None), ("z", d)}
    assert got[("z", d)].n == 2 and got[("z", d)].p50 == -1.0 and got[(None, None)].p50 == 2.0
    whole = {r.label: r for r in Q.percentiles(Q.merge_sketches(days, ["label"], 256), ["label"], [0.5, 0.999]).collect()}["move"]
    assert whole.n == 9000 and abs((hot <= whole.p50).sum() - 4500) <= whole.rank_error and hasattr(whole, "p99_9")
    assert Q.duration_sketches(spark.createDataFrame([], SEGMENTS)).count() == 0


# ---- splits ----------------------------------------------------------------------------------

EPISODES = "episode_index bigint, recording_id string, workpiece string, derived_from bigint, extra string"


def plain_components(edges):
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {a: find(a) for a in root}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(500 + i, 501 + i) for i in range(40)] + [(1000, 1001 + i) for i in range(60)]
    got = {r.node: r.component for r in S.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == plain_components(edges)


def test_ties(spark):
    rows = [
        (5, "Rec-1 a", None, None), (3, "rec_1A", "n/a", None), (9, "other", "WP 7", 3), (11, "tbd", " wp-7)", -1), (12, "TBD", "--", 12), (13, None, None, 77), (14, "?", "unknown", 77), (20, "", "", None), (None, "rec1a", None, None),
        (5, "Rec-1 a", None, None),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], EPISODES)
    got = {r.episode_index: r.group for r in S.episode_groups(df).collect()}
    assert got == {3: 3, 5: 3, 9: 3, 11: 3, 12: 12, 13: 13, 14: 13, 20: 20}
    frames = spark.createDataFrame([(e, i) for e in (3, 5, 9, 11, 12, 50) for i in range(3)] + [(3, 0), (None, 1)], "episode_index bigint, frame_index bigint")
    w = {"train": 0.5, "test": 0.5, "never": 0.0}
    out = S.split_frames(frames, df, w).collect()
    assert len(out) == 18 and len({r.split for r in out if r.episode_index in (3, 5, 9, 11)}) == 1 and {r.split for r in out} <= {"train", "test"}
    assert S.episode_groups(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        S.rendezvous(F.lit(1), {"a": 0.0})


def test_shares(spark):
    g = spark.range(20000).select(S.rendezvous(F.col("id"), {"train": 0.8, "validation": 0.1, "test": 0.1}).alias("s"), S.rendezvous(F.col("id"), {"train": 0.8, "validation": 0.1, "test": 0.1, "new": 0.1}).alias("t"))
    n = {r.s: r["count"] / 20000 for r in g.groupBy("s").count().collect()}
    assert n == pytest.approx({"train": 0.8, "validation": 0.1, "test": 0.1}, abs=0.01)
    assert g.where("t <> 'new' and s <> t").count() == 0


# ---- tokens ----------------------------------------------------------------------------------

ODD = ["", " ", "\n\n", "it's DON'T we'll", "a\x85b    c \x1c\x1d x", "日本語 ²³ Ⅷ", "🤖🦾" * 40, " \t\r\n\x0b\x0c x", "<|endoftext|>", "x" * 5000, "é" * 300, "\x00\x01\x7f", "a" + " " * 3000 + "b", "naïve ﬁ ’s", "﻿​ "]


def reference_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=T.read_ranks(T.vocabulary_path("byte_bpe_50k")), special_tokens={})


def test_ids_equal_the_vocabularys_own_encoder():
    enc = reference_encoding()
    code = T.Codec(T.vocabulary_path("byte_bpe_50k"))
    rng = random.Random(0)
    texts = ODD + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(128, 0xD7FF), 32, 10])) for _ in range(rng.randrange(200))) for _ in range(200)]
    for t in texts:
        assert code.encode(t) == enc.encode_ordinary(t)
        assert code.decode(code.encode(t)).decode() == t
        assert code.count(t) == len(code.encode(t))


def test_forgetting_changes_nothing(monkeypatch):
    code = T.Codec(T.vocabulary_path("byte_bpe_50k"))
    want = [code.encode(t) for t in ODD]
    monkeypatch.setattr(T, "REMEMBERED", 2)
    code.met.clear()
    assert [code.encode(t) for t in ODD] == want


def test_encoding_of_tables(spark):
    df = spark.createDataFrame([(1, "hello world", 5), (2, None, 6), (3, "", 7), (3, "", 7)], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in T.encode_texts(df).collect())
    assert got == [(1, [31373, 995]), (2, None), (3, []), (3, [])]
    assert sorted((r.doc_id, r.n_tokens) for r in T.count_tokens(df).collect() if r.doc_id < 3) == [(1, 2), (2, None)]
    assert sorted((r.doc_id, r.text) for r in T.decode_ids(T.encode_texts(df)).distinct().collect()) == [(1, "hello world"), (2, None), (3, "")]
    assert T.encode_texts(df.limit(0)).count() == 0


# ---- containers ------------------------------------------------------------------------------


def test_packer_is_best_fit():
    p = P.Packer(10, 2)
    for k, size in enumerate([6, 7, 3, 4, 9]):
        p.add(size, (k, size))
    # 3 fills the one with 7 to the brim, 4 the one with 6
    assert sorted(sorted(k for k, _ in c) for c in p.closed) == [[0, 3], [1, 2]]
    p.add(8, (5, 8))
    p.add(5, (6, 5))
    assert [(4, 9)] in p.closed  # the fullest closed first
    p.finish()
    assert sum(s for c in p.closed for _, s in c) == 6 + 7 + 3 + 4 + 9 + 8 + 5 and p.n_open == 0


@pytest.mark.parametrize("spread", ["short", "long", "mixed"])
def test_little_room_is_left(spread):
    rng = np.random.default_rng(6)
    sizes = {"short": rng.integers(1, 120, 20000), "long": rng.integers(300, 700, 20000), "mixed": np.minimum(1024, rng.lognormal(5, 1.2, 20000).astype(int) + 1)}[spread]
    p = P.Packer(1024)
    for i, n in enumerate(sizes.tolist()):
        p.add(n, (i, n))
    p.finish()
    full = [sum(n for _, n in items) for items in p.closed]
    assert sum(full) == sizes.sum() and max(full) <= 1024
    least = {"short": 0.99, "long": 0.9, "mixed": 0.985}[spread]
    assert sum(full) / (1024 * len(full)) > least


def test_containers(spark):
    rng = random.Random(5)
    docs = [(i, " a" * rng.choice([1, 5, 30, 90]), 1) for i in range(400)] + [(900, " a" * 250, 1), (901, None, 1), (902, "", 1), (1, " a" * 5, 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, piece int")
    targets = spark.createDataFrame([("small", "byte_bpe_50k", 100), ("large", "byte_bpe_50k", 1000), ("large", "byte_bpe_50k", 1000)], "target_name string, tokenizer string, capacity_tokens int")
    rows = P.fill_containers(df, targets, group=8).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, P.fill_containers(df.repartition(7), targets, group=8).collect()), key=str)
    for name, cap in (("small", 100), ("large", 1000)):
        own = [r for r in rows if r.target_name == name]
        size = {}
        for r in own:
            if r.container is None:
                assert r.n_tokens == 0 and r.doc_id in (901, 902)
            else:
                size[r.container] = size.get(r.container, 0) + r.n_tokens
        assert max(size.values()) <= cap and sum(size.values()) == sum(t.count(" a") for _, t, _ in docs if t)
        assert sum(size.values()) / (cap * len(size)) > 0.75
        pieces = sorted((r.piece, r.start_token, r.n_tokens) for r in own if r.doc_id == 900)
        assert pieces == ([(0, 0, 100), (1, 100, 100), (2, 200, 50)] if cap == 100 else [(0, 0, 250)])
        assert len([r for r in own if r.doc_id == 1]) == 2
    assert P.fill_containers(df.limit(0), targets).count() == 0 and P.fill_containers(df, targets.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.fill_containers(df, targets.withColumn("capacity_tokens", F.lit(0)))


# ---- residue ---------------------------------------------------------------------------------

HEAD = "commit 5c56d3b492c0ef50ebbeee607e65c0e504bc3d2a\nAuthor: a b <a.b@x.example>\nDate:   2025-04-25 18:40:44 +0000\n\n    "
DIFF = "\n\ndiff --git a/x.html b/x.html\n--- a/x.html\n+++ b/x.html\n@@ -1,2 +1,2 @@\n+<td>{{ name }}</td>\n+<noscript>Please enable JavaScript.</noscript>\n+404 - page not found\n+TODO_NAME lorem ipsum dolor sit amet\n"
GOOD = [
    "Simplify the boundary merge", "Rename '[%Summary%]' to `$NAME$` in the launch template", 'Do not cache pages that say "Something went wrong"', "Treat access denied on a/b.cfg as a missing file", "Retry uploads on 502 and 503 from the store, up to 6 times",
    "viewer: show a JavaScript notice when x cannot start", "Replace the lorem ipsum on the demo page", "Handle errors\n\n> 404 - page not found\n> Try again in a few minutes.\nThe line above came from the proxy log.", "chore(release): 1.0.0 [skip ci]",
    "Add dwell\n\nSigned-off-by: a b <a@b.example>", "see <|endoftext|> handling", "Docs\n\n## Why\nBecause it was slow.\n- [ ] ask the night shift", "Keep __init__ small", "整理（再起動後）", "buffer used to swallow the error and carry on.", "[delta] Drop a", "Merge branch 'x' into main\n\n# Conflicts:\n#\ta/b.py",
]
BAD = {
    "placeholder": ["Move <your title here> after restart", "Fix\n\n{{author}}", "Split ${ticket_id}", "x: [INSERT REASON]", "Log (fill in summary)", "Drop ____author____", "Stop @@TITLE@@", "<motivo del cambio>: x", "## What\n\n(please fill in)\n\n## Why\nfast", "## Why\n<!-- describe the change here -->", "Test %(title)s", "「」 【変更理由を入力】", "a\n&lt;scope&gt;: b", "{Component}: x"],
    "filler": ["Lorem ipsum dolor sit amet. Culpa qui officia deserunt.", "Your content goes here. Paragraph one. Paragraph two."],
    "error": ["404 - page not found", "<html><head><title>Gateway timed out</title></head><body></body></html>", '{"status": "error", "title": "Quota exceeded", "detail": "x"}', "Access denied - Retry after 5 seconds.", "ACCESS DENIED\nCheck the link.", "Página não encontrada"],
    "script": ["<noscript>Scripts are blocked.</noscript>", "You need to enable JavaScript to run this app.", "&lt;noscript&gt;x&lt;/noscript&gt;", "Veuillez activer JavaScript pour continuer."],
}


def found(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "r", "s", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, repo string, source string, placeholder int")
    return {r.doc_id: {k for k in ("placeholder", "filler", "error", "script") if r[k]} for r in R.residue(df, **kw).collect()}


def test_residue(spark):
    texts = [(None, t) for t in GOOD] + [(k, t) for k, own in BAD.items() for t in own]
    for wrap in (lambda t: t, lambda t: t + DIFF, lambda t: HEAD + t.replace("\n", "\n    ") + DIFF, lambda t: (HEAD + t.replace("\n", "\n    ") + DIFF).replace("\n", "\r\n"), lambda t: f"# 0c02e94a84 | a.b | 2025-05-04\n{t}{DIFF}", lambda t: f"From 63845fb1eaac\nFrom: a <a@b.example>\nSubject: [PATCH 1/2] {t}{DIFF}"):
        got = found(spark, [wrap(t) for _, t in texts])
        assert {i for i, (k, _) in enumerate(texts) if k} == set(got)
        for i, (k, t) in enumerate(texts):
            assert k is None or k in got[i], t


def test_residue_of_nothing(spark):
    assert found(spark, [None, "", " \n\t", DIFF, "x " * 200_000]) == {}
    assert found(spark, []) == {}
    clean = R.without_residue(spark.createDataFrame([(1, "{{x}}", None, None), (2, "ok", None, None), (None, "{{x}}", "r", None)], "doc_id bigint, text string, repo string, source string"))
    assert sorted(r.text for r in clean.collect()) == ["ok", "{{x}}"]


def test_boilerplate_is_subtracted(spark):
    texts = [f"Fix item {i}\n\nNotice: {{{{team}}}} 4711" for i in range(20)]
    assert len(found(spark, texts)) == 20
    assert found(spark, texts, share=0.5, least=10) == {}


FILLERS = [
    "Blindtext für das Layout. Hier steht später der richtige Text. Mustertext, bitte ersetzen.", "Aquí va su contenido. Texto de relleno, sustituir después.", "Texto provisório, substituir depois. Seu texto aqui.", "Faux texte pour la mise en page. Texte de remplissage, à remplacer.",
    "Votre texte ici.", "Здесь будет ваш текст. Текст-заполнитель, заменить позже.", "これはダミーテキストです。 ここに本文が入ります。", "これはダミーテキストです。ここに本文が入ります。", "此处为占位文字。 示例文本，稍后替换。",
]
SPOKEN = [
    "Mustertext im Layout ersetzt", "Quita el texto de relleno de la portada", "Remove o texto provisório", "Retire le faux texte de l'accueil", "Заменить текст-заполнитель на главной", "ダミーテキストを削除", "删除占位文字",
    "Antes o índice de episódios era lido duas vezes. Antes o índice de episódios era lido duas vezes.",
]


def test_filler_of_other_languages(spark):
    texts = FILLERS + SPOKEN
    for wrap in (lambda t: t, lambda t: HEAD + "Titel\n    " + t + DIFF):
        got = found(spark, [wrap(t) for t in texts])
        assert {k: v for k, v in got.items()} == {k: {"filler"} for k in range(len(FILLERS))}


def test_full_width_slots(spark):
    got = found(spark, ["削除： ＜ここに概要を記入＞（長い記録）", "件名 ｛｛氏名｝｝", "整理：値 ＜ 上限"])
    assert got == {0: {"placeholder"}, 1: {"placeholder"}}


def test_recurrent_evidence_is_kept(spark):
    pages = ["404 - page not found", "Bitte aktivieren Sie JavaScript.", "Lorem ipsum dolor sit amet.", "Fix\n\n{{author}}", "Fix\n\n## Why\n(please say why)"]
    for page in pages:
        # the same host ten times larger
        for n in (10, 200):
            texts = [page if i % 5 < 2 else f"Add step {'ab'[i % 2] * (i + 1)}" for i in range(n)]
            assert set(found(spark, texts)) == {i for i in range(n) if i % 5 < 2}, (page, n)


def test_subtraction_joins_nothing(spark):
    # what parts a heading from a bracket recurs, so it is subtracted, but no empty section comes of it
    assert found(spark, [f"Add {'a' * (i + 1)}\n\n## Why\nSame as before.\n(see the log)" for i in range(60)]) == {}
    # whole lines of evidence stay when slots are given up
    assert found(spark, ["404 - page not found\nTry again."] * 20, share=0.5, least=10) == {i: {"error"} for i in range(20)}


def test_subtraction_decides_what_is_left(spark):
    """A host's footer hides filler and error pages that go over lines, until it is subtracted; without other lines that recur there is no difference."""
    foot = "\nBuilt by the night robot, run {}"
    spread = {"filler": ["Title\nSome words to fill\nthe page", "Lorem ipsum\ndolor sit\namet elit.", "题目\n此处为占位\n文字。"], "error": ["404\nNot Found", 'Title\n{\n"code": 5,\n"title": "Quota exceeded"\n}', "Title\nLa página solicitada\nno existe"]}
    texts = [(k, t) for k, ts in spread.items() for t in ts] + [(None, f"Add step {'a' * (i + 1)}\nThe page is\nfound again.") for i in range(6)]
    want = {i: {k} for i, (k, _) in enumerate(texts) if k}
    assert found(spark, [t + foot.format(i) for i, (_, t) in enumerate(texts)]) == want
    assert found(spark, [t + foot.format(i) for i, (_, t) in enumerate(texts)], share=2) == {}
    assert found(spark, [t for _, t in texts]) == found(spark, [t for _, t in texts], share=2) == want


def test_recurrent_evidence_of_many_lines_is_kept(spark):
    page = 'Title {}\n<div class="n"\nid="x"\ntitle="y"\nrole="alert">JavaScript is required'
    assert found(spark, [page.format("a" * (i + 1)) for i in range(10)]) == {i: {"script"} for i in range(10)}
    # what the next line begins with doesn't matter
    assert found(spark, ["Title\nYour text here.\nText to follow in the next release"]) == {0: {"filler"}}


HELD_OUT = {
    "error": (
        "410 Gone", "HTTP 429: Too Many Requests", "HTTP/1.1 502 Bad Gateway", "Error 451 - Unavailable For Legal Reasons", "507 Insufficient Storage", "The page you requested could not be found.", "This site can't be reached", "Sorry, the service is temporarily unavailable",
        "The server is not responding", "Die angeforderte Seite wurde nicht gefunden", "Der Dienst ist derzeit nicht verfügbar", "La page demandée est introuvable", "Le service est temporairement indisponible", "La página solicitada no existe", "El servicio no está disponible",
        "A página solicitada não foi encontrada", "Запрошенная страница не найдена", "Сервис временно недоступен", "お探しのページは見つかりませんでした", "您访问的页面不存在",
    ),
    "script": (
        "Please activate JavaScript in order to use this site.", "This content requires JavaScript to be enabled.", "JavaScript must be turned on to proceed.", "Your web browser has scripting disabled.", "We're sorry, but this website needs scripts to be allowed.", "Diese Seite benötigt JavaScript.",
        "Ihr Browser hat JavaScript deaktiviert.", "Votre navigateur a désactivé JavaScript.", "Este sitio requiere JavaScript para mostrar el contenido.", "Seu navegador está com o JavaScript desativado.", "Для работы сайта требуется JavaScript.", "В вашем браузере отключён JavaScript.",
        "このページは JavaScript が必要です。", "ブラウザの JavaScript が無効になっています。", "您的浏览器禁用了 JavaScript。", "本网站需要启用脚本。",
    ),
    "filler": ("Insert your text here.", "Add a description here", "Your headline goes here", "Sample text here. Sample text here.", "Hier bitte Text einfügen.", "Insérez votre texte ici.", "Escriba su texto aquí.", "Digite o seu texto aqui.", "Введите текст здесь."),
}
GENUINE = (
    "Handle 404 not found in the mirror client", "Return 502 when the upstream resets", "Enable JavaScript source maps in the release build", "Drop the script that needs root", "Allow scripts to read the new limits", "Show a notice when scripts are blocked", "Add text here and there in the guide",
    "The server is restarted after each upload", "Make the page work without JavaScript", "Insert a newline after the header", "Page numbers start at one now", "Service names are no longer cached", "Write the summary to disk", "js: move the loader to its own file", "Require scripts to name their inputs",
    "Seite der Fehlerliste nach oben verschoben", "Le service lit la page suivante", "La página de ayuda enlaza al manual", "Страница помощи обновлена", "ページの余白を直す",
)


def test_wordings_that_no_list_holds(spark):
    """Of held-out wordings at least nine in ten are found, and genuine subjects near them aren't."""
    texts = [(k, w) for k, ws in HELD_OUT.items() for w in ws] + [("none", w) for w in GENUINE]
    docs = spark.createDataFrame([(i, f"Title of the change\n\n{w}\n", f"r{i}", "s") for i, (_, w) in enumerate(texts)], "doc_id bigint, text string, repo string, source string")
    found = {r.doc_id: r for r in R.evidence(docs).collect()}
    for kind, words in HELD_OUT.items():
        hit = [w for i, (k, w) in enumerate(texts) if k == kind and found[i][kind]]
        assert len(hit) >= 0.9 * len(words), set(words) - set(hit)
    assert [w for i, (k, w) in enumerate(texts) if k == "none" and any(found[i][x] for x in ("placeholder", "filler", "error", "script"))] == []


def test_texts_of_any_length_are_read(spark):
    """Repeated groups of a million pieces on one line neither fail nor count."""
    texts = ["<a> " * 50000 + "please enable the " * 9, "{{" * 100000, "the page the page " * 50000, "bitte später noch " * 50000, "Re: Re: " * 50000, "test test " * 50000, "Title\n" + "a line of text\n" * 50000 + "To see this, please enable JavaScript."]
    docs = spark.createDataFrame([(i, t, f"r{i}", "s") for i, t in enumerate(texts)], "doc_id bigint, text string, repo string, source string")
    found = {r.doc_id: [k for k in ("placeholder", "filler", "error", "script") if r[k]] for r in R.evidence(docs).collect()}
    assert found == {0: [], 1: [], 2: [], 3: [], 4: [], 5: ["filler"], 6: ["script"]}
