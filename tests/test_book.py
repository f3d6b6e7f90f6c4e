"""Hand-derived results of the book functions."""

import pytest
from pyspark.sql import functions as F

from fabula.functions import audio, keys, text as T
from fabula.functions.numbers import digits_to_words, integer_to_words, numbers_to_words, spell
from fabula.operators import chapters, dialogue, segment, state, synth
from fabula.sources import readers, writers


def values(spark, inputs, expr, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, t {kind}")
    return [r.v for r in df.select("i", expr(F.col("t")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "function,cases",
    [
        (digits_to_words, {"0": "ноль", "00": "ноль", "1": "один", "11": "одиннадцать", "21": "двадцать один", "236": "двести тридцать шесть", "007": "семь", "1000": "одна тысяча", "2000": "две тысячи", "5000": "пять тысяч", "11000": "одиннадцать тысяч", "21000": "двадцать одна тысяча", "1000000": "один миллион", "2000001": "два миллиона один", "1000000000000": "один", "٣": "три"}),
        (numbers_to_words, {"007": "семь", "3.14": "три.четырнадцать", "A4": "Aчетыре", "": "", "нет": "нет"}),
        (T.fold_marks, {"?!": "?", "!?": "?", "?!?": "??", "!?!": "?!"}),
        (T.strip_commas, {"ну, блин, я": "ну блин я", "ну, блинчик, я": "ну блинчик я", "ну, Короче , я": "ну Короче я", "блин\n, короче": "блин короче"}),
        (T.terminal, {"а,": "а.", "а…": "а…", "а": "а.", "": "."}),
        (T.mark_question, {"Что ?": "*Что*?", "Что??": "Что??", "*да*?": "*да*?", "??": "??", "да": "да"}),
        (T.tts_clean, {"***": "", "* * *.": "", '"да"': "да"}),
        (T.speaker_normalize, {"«Да…»": "Да.", "....": ".."}),
        (T.safe_name, {" ": "chapter", "a/b:c. ": "a_b_c"}),
        (T.short_title, {"Том 1 Глава 2: Мост": "Глава 2 Мост", "Пролог": "Пролог"}),
        (T.heading_normalize, {"Глава 1—Кто-то": "Глава 1 - Кто - то"}),
        (T.compact_wide, {"a b\u200bc": "a bc", "  ": ""}),
        (T.capitalize, {"ёж": "Ёж", "": "", "aB": "AB"}),
        (T.capitalize_letter, {"ёж": "Ёж", "": "", "ßa": "ẞa", "ŉa": "ŉa", "ﬁn": "ﬁn", "ᾳ": "ᾼ", "ΐ": "ΐ", "ǆa": "Ǆa", "😀": "😀"}),
        (T.clean_wrappers, {"\ufeff\ufeff`a ": "a"}),
        (T.unescape_newlines, {"a\\r\\nb\\nc\\rd": "a\nb\nc\nd"}),
        (T.isolate_headings, {"конец. Том 1 Глава 2 - Мост\nда": "конец.\n\nТом 1 Глава 2 - Мост\n\nда"}),
        (T.is_heading, {"Глава 5": True, "Глава 5. X": False, "Том 1 Глава 2 - Да": True, "Глава 5:X": False, "Глава 5: X": True, "глава 5": False}),
    ],
)
def test_text(spark, function, cases):
    assert values(spark, list(cases), function) == list(cases.values())


def test_spelling_is_one(spark):
    texts = ["007 и 1000000000001, 21 000 x12y٣", "1002003 4000 14 0"]
    assert values(spark, texts, numbers_to_words) == [spell(t) for t in texts]


def test_integers(spark):
    assert values(spark, [-5, 0, 101], integer_to_words, "long") == ["минус пять", "ноль", "сто один"]


def test_audio(spark):
    specs = {"-5%": 0.95, "+3 hz": 1.015, "x": None, "-200hz": None, "-100%": None, "": None}
    got = values(spark, list(specs), audio.pitch_factor)
    assert got == [None if v is None else pytest.approx(v) for v in specs.values()]
    chains = values(spark, [0.3, 5.0, 1.0, 2.0, 0.5, 8.0], audio.tempo_chain, "double")
    assert [[round(x, 6) for x in c] for c in chains] == [[0.5, 0.6], [2, 2, 1.25], [1], [2], [0.5], [2, 2, 2]]
    assert values(spark, ["+0%", "+100%"], lambda t: audio.tone_filter(t, 48000)) == ["copy", "asetrate=48000*2.000000000,aresample=48000,atempo=0.500000"]


def test_segments(spark):
    assert values(spark, ["x" * 25, "aa bb cc", ""], lambda t: segment.pack_words(t, 10)) == [["x" * 10, "x" * 10, "x" * 5], ["aa bb cc"], []]
    assert values(spark, [["aa", "bb", "c"]], lambda t: segment.pack_neighbors(t, 5), "array<string>") == [["aa bb", "c"]]
    assert segment.balance(["x" * 10, "y" * 10], 10) == ["x" * 10, "y" * 10]
    assert segment.balance(["a" * 20], 10) == ["a" * 10, "a" * 10]
    assert values(spark, ["A.B т.е да… Нет"], segment.sentences_tight) == [["A.", "B т.е да…", "Нет"]]
    assert values(spark, ["ab... c. d"], segment.sentences) == [["ab...", "c.", "d"]]
    assert values(spark, ["a\x0bb\u2028c\r\n\r\nd"], segment.lines) == [["a", "b", "c", "d"]]
    assert values(spark, ["a\n \nb", "\n\n"], segment.paragraphs) == [["a", "b"], []]
    assert values(spark, ["a\n \nb\n\n\n\nc"], segment.plain_paragraphs) == [["a\n \nb", "c"]]


def test_chunks_stay_within_the_limit(spark):
    text = "\n\n".join(f"Слово {i} " * (i % 40) + "конец. " * (i % 7) for i in range(60)) + "ы" * 700
    (chunks,) = values(spark, [text], lambda t: segment.chunk_text(t, 100))
    assert max(map(len, chunks)) <= 100
    assert "".join("".join(chunks).split()) == "".join(text.split())
    with pytest.raises(ValueError):
        segment.chunk_text(F.col("t"), 0)


BOOK = """— Вы тоже не можете уснуть? — раздался голос за его спиной.

Он обернулся

— Нет... Но разве это обязательно в 13?! — она улыбнулась. — Меня зовут Вера

— Подождите! Не уходите! — он схватил её за руку, вздохнув

— Да какая разница! Главное — вы здесь! Вы это серьёзно?

-"""


def chunks(spark, text, **how):
    rows = dialogue.parse_book(spark.createDataFrame([(1, text)], "doc_id int, text string"), **how).orderBy("para_idx", "chunk_idx").collect()
    return [(r.type, r.text, r.ssml, r.post_tone) for r in rows]


def test_dialogue(spark):
    got = chunks(spark, BOOK)
    assert [c[:2] for c in got] == [
        ("question", "Вы тоже не можете *уснуть*?"), ("author", "Раздался голос за его спиной."), ("author", "Он обернулся."), ("line", "Нет..."),
        ("question", "Но разве это обязательно в *тринадцать*?"), ("author", "Она улыбнулась."), ("line", "Меня зовут Вера."),
        ("exclamation", "Подождите! Не уходите!"), ("author", "Он схватил её за руку, вздохнув."), ("exclamation", "Да какая разница! Главное - вы здесь!"),
        ("question", "Вы это *серьёзно*?"),
    ]
    assert got[0][2] == "<speak><p>Вы тоже не можете *уснуть*?</p></speak>"
    assert got[1][2] is None
    assert got[3][2] == '<speak><p><prosody pitch="high" rate="medium">Нет...</prosody></p></speak>'
    assert {c[3] for c in got} == {None}


def test_long_chunks_are_cut(spark):
    got = chunks(spark, "- " + "слово " * 40 + "конец?\n\n" + "Автор идёт. " * 30, most=60)
    assert {c[0] for c in got} == {"line", "question", "author"}
    assert max(len(c[1]) for c in got) <= 62
    assert chunks(spark, "- " + "слово " * 40, most=0)[0][1].startswith("Слово слово")


def test_profiles(spark):
    loud = dialogue.PROFILES | {"line": {"rate": "fast", "pitch_shift": " -5% "}, "author": {"pitch": "low"}}
    got = chunks(spark, "- Да & нет\n\nОн ушёл", profiles=loud)
    assert got == [
        ("line", "Да & нет.", '<speak><p><prosody pitch="medium" rate="fast">Да &amp; нет.</prosody></p></speak>', "-5%"),
        ("author", "Он ушёл.", '<speak><p><prosody pitch="low" rate="medium">Он ушёл.</prosody></p></speak>', None),
    ]
    with pytest.raises(ValueError):
        chunks(spark, "a", profiles={"line": {}})


@pytest.mark.parametrize("text,expected", [("Если произнести трижды", False), ("медленно произнёс я", True), ("Грак спросил", True), ("он сказал?", False), ("сказал он?", True), ("сказали", True), ("сказание", False)])
def test_remarks(spark, text, expected):
    assert values(spark, [text], dialogue.is_remark) == [expected]


def test_chapters(spark):
    books = [
        (1, ["Глава 1", "Глава 2", "да"], "Книга"), (2, ["да", "Глава 3 - Х"], "Книга"), (3, ["Глава 1"], "Книга"),
        (4, ["Книга", "текст", "Глава 2: Мост", "а", "б"], "Книга"),
    ]
    df = spark.createDataFrame(books, "doc_id int, paragraphs array<string>, title string")
    got = {}
    for r in chapters.split_chapters(df).orderBy("doc_id", "chapter_idx").collect():
        got.setdefault(r.doc_id, []).append((r.title, list(r.paragraphs)))
    assert got == {1: [("Глава 2", ["да"])], 2: [("Книга", ["да"])], 3: [("Глава 1", [])], 4: [("Книга", ["текст"]), ("Глава 2: Мост", ["а", "б"])]}


FB2 = f"""<?xml version="1.0" encoding="utf-8"?><FictionBook xmlns="{readers.NAMESPACE}"><body><p>потеряно</p>
<section><title><p>Глава</p><p>первая</p></title><p>а <em>б</em> в</p><section><p>г</p></section><v>стих</v></section><section><p> </p></section><section><p>д</p></section></body>
<body><section><p>сноска</p></section></body></FictionBook>"""


def test_fb2(spark, tmp_path):
    assert readers.book_chapters(FB2.encode()) == [("Глава первая", ["Глава", "первая", "а б в", "г"]), ("Глава 3", ["д"])]
    flat = f'<FictionBook xmlns="{readers.NAMESPACE}"><body><p>а</p></body></FictionBook>'
    assert readers.book_chapters(flat.encode()) == [("Книга", ["а"])]
    assert readers.book_chapters(f'<FictionBook xmlns="{readers.NAMESPACE}"/>'.encode()) == []
    (tmp_path / "a.fb2").write_text(FB2)
    (tmp_path / "b.fb2").write_text("<a>")
    rows = readers.read_fb2(spark, str(tmp_path)).collect()
    assert sorted((r.title or "", bool(r.error)) for r in rows) == [("", True), ("Глава 3", False), ("Глава первая", False)]
    df = spark.createDataFrame([(1, "Имя", 1, "Глава 1", ["а\n б", " ", "<в>"])], "b int, book_title string, chapter_idx int, title string, paragraphs array<string>")
    made = writers.fb2_files(df, "b", "2024-01-02", ("И", "Ф")).first().fb2
    assert readers.book_chapters(made.encode()) == [("Глава 1", ["Глава 1", "а б", "<в>"])]
    assert 'value="2024-01-02"' in made and "<last-name>Ф</last-name>" in made


def test_chunk_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"type":"line","text":"да","ssml":" ","pitch_shift":"-5%"},{"type":" ","text":"x"},{"type":"author"},{"type":"q","text":"т","post_tone":"+1%"}]')
    good, bad = readers.read_chunks(spark, str(tmp_path / "a.json"))
    assert [(r.chunk_idx, r.type, r.text, r.ssml, r.post_tone) for r in good.orderBy("chunk_idx").collect()] == [(1, "line", "да", None, "-5%"), (4, "q", "т", None, "+1%")]
    assert [(r.chunk_idx, r.reason) for r in bad.orderBy("chunk_idx").collect()] == [(2, "no type"), (3, "no text")]
    (tmp_path / "t.txt").write_bytes("а\r\n\r\nб".encode())
    assert [r.text for r in readers.read_book(spark, str(tmp_path / "t.txt")).orderBy("para_idx").collect()] == ["А.", "Б."]
    with pytest.raises(ValueError):
        readers.read_book(spark, "x.doc")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    assert "�" in readers.read_texts(spark, str(tmp_path / "bad.txt"), strict=False).first().text
    with pytest.raises(Exception):
        readers.read_texts(spark, str(tmp_path / "bad.txt")).collect()


def test_empty_files_are_rejected(spark, tmp_path):
    for name, text in (("a.txt", " да\r\n"), ("b.txt", "\n"), ("c.txt", " \n\u00a0")):
        (tmp_path / name).write_text(text)
    valid, rejected = readers.read_filled_texts(spark, str(tmp_path))
    assert [r.text for r in valid.collect()] == ["да"] and valid.columns == ["path", "text"]
    assert sorted((r.path[-5:], r.text, r.reason) for r in rejected.collect()) == [("b.txt", "", "empty"), ("c.txt", "", "empty")]


def test_parsed_files(spark):
    df = spark.createDataFrame([(1, 1, "line", "да", "<s>", ""), (1, 0, "author", "он", None, "-5%")], "b int, i int, type string, text string, ssml string, post_tone string")
    r = writers.parsed_files(df, "b", ["i"]).first()
    assert r.lines == "[author]: он\n[line]: да\n"
    assert r.json == '[\n  {"type":"author","text":"он","post_tone":"-5%"},\n  {"type":"line","text":"да","ssml":"<s>"}\n]'


def test_state(spark):
    chapters_ = spark.createDataFrame([("a", 250, "x"), ("b", 250, "y"), ("c", 250, "z")], "chapter_key string, max_chars int, text string")
    cache = spark.createDataFrame([("a", 250, ["q", " "]), ("b", 100, ["w"]), ("c", 250, [" "])], "chapter_key string, max_chars int, chunks array<string>")
    got = state.with_cached_chunks(chapters_, cache, F.array("text")).orderBy("chapter_key").collect()
    assert [(list(r.chunks), r.from_cache) for r in got] == [(["q"], True), (["y"], False), (["z"], False)]
    parts = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    assert len(spark.range(1).select(state.playlist(parts, F.lit("s"), 0.1).alias("v")).first().v) == 5
    assert len(spark.range(1).select(state.playlist(F.array(F.lit("a")), F.lit("s"), 0.1).alias("v")).first().v) == 1
    assert len(spark.range(1).select(state.playlist(parts, F.lit("s"), 0.0).alias("v")).first().v) == 3


def test_synthesis(spark):
    df = spark.createDataFrame([(1, 0, "да", "<s>да</s>", None), (1, 1, '"нет"', "<s>", None), (1, 2, "***", "<s>", None), (1, 3, "фуЖ", None, "-5%")], "b int, i int, text string, ssml string, post_tone string")
    planned = synth.plan(df, " абвгдежзийклмнопрсту")
    rows = {r.i: (r.try_markup, r.try_text, r.try_allowed) for r in planned.collect()}
    assert rows == {0: ("<s>да</s>", "да", None), 1: (None, "нет", None), 2: (None, None, None), 3: (None, "фуЖ", "уж")}
    refuse = lambda t: t.startswith("<s>") or "ф" in t
    made = synth.synthesize(planned, lambda: synth.ToneDouble(8000, refuse)).cache()
    assert {r.i: r.attempt for r in made.collect()} == {0: "text", 1: "text", 2: None, 3: "allowed"}
    assert [(r.i, r.reason) for r in synth.rejected(made).collect()] == [(2, "empty after cleaning")]
    spent = synth.elapsed(made, ["b"]).first()
    assert spent.n_chunks == 4 and spent.seconds > 0
    again = {r.i: r.try_allowed for r in synth.plan(df, " абвгдежзийклмнопрсту", "again").collect()}
    assert again[0] == "да" and again[2] is None
    r = synth.join_chapters(made, ["b"], "i", 0.1).first()
    assert r.n_parts == 3 and synth.sample_rate(bytes(r.wav)) == 8000
    assert len(bytes(r.wav)) == 44 + 2 * (8 * (2 + 3 + 2) + 2 * 800)
    with pytest.raises(ValueError):
        synth.joined([], 0.1)
    marked = synth.accented(spark.createDataFrame([("«да»",), (" ",)], "paragraph string"), lambda: lambda t: t.replace("а", "+а"))
    assert [r.accented for r in marked.collect()] == ['"д+а"', None]


def test_incremental(spark, tmp_path):
    from fabula.streaming.incremental import run_once

    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.createDataFrame([(1, "а"), (2, "- б?")], "doc_id long, text string").write.parquet(src)
    run_once(spark, src, out, mark)
    spark.createDataFrame([(3, "в")], "doc_id long, text string").write.mode("append").parquet(src)
    run_once(spark, src, out, mark)
    run_once(spark, src, out, mark)
    assert sorted((r.doc_id, r.text) for r in spark.read.parquet(out).collect()) == [(1, "А."), (2, "*Б*?"), (3, "В.")]


def test_a_batch_that_is_run_again_is_there_once(spark, tmp_path):
    from fabula.streaming.incremental import run_once

    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.createDataFrame([(1, "а")], "doc_id long, text string").write.parquet(src)
    run_once(spark, src, out, mark)
    run_once(spark, src, out, str(tmp_path / "other"))  # as after a checkpoint that was lost
    assert [(r.doc_id, r.batch) for r in spark.read.parquet(out).collect()] == [(1, 0)]


def test_tables_by_key(spark, tmp_path):
    path = str(tmp_path / "state")
    assert writers.read_keyed(spark, path) is None
    row = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    assert writers.write_keyed(row(("a", 1), ("b", 2)), path, ["k"]) == 0
    assert writers.write_keyed(row(("b", 3), ("c", 4)), path, ["k"]) == 1
    (tmp_path / "state" / "v2").mkdir()  # a run that was cut off
    assert sorted(map(tuple, writers.read_keyed(spark, path).collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_model_folder():
    assert readers.model_folder("M", "x", {"M": "/m", "HOME": "/h"}) == "/m"
    assert readers.model_folder("M", "x", {"XDG_CACHE_HOME": "/c", "HOME": "/h"}) == "/c/x"
    assert readers.model_folder("M", "x", {"HOME": "/h"}) == "/h/.cache/x"


def test_long_texts_pack_as_the_plain_fold_does(spark):
    import random

    rng = random.Random(2)
    texts = ["".join(rng.choice("ab.!?… \n") for _ in range(rng.randrange(200))) for _ in range(60)] + ["слово " * 20_000, "я" * 5000 + " " + "ab. " * 3000]
    for most in (1, 2, 7, 30):
        got = values(spark, texts, lambda t, m=most: segment.pack_words(t, m))
        assert got == [segment.words_within(t, most) for t in texts]


def test_limits_must_be_positive():
    for function in (segment.pack_words, segment.pack_sentences, segment.pack_neighbors, segment.balanced, segment.chunk_text, segment.chunk_paragraphs, segment.chunk_lines):
        with pytest.raises(ValueError):
            function(F.lit("x"), 0)


def test_dotenv():
    env = {"A": "1"}
    assert readers.load_dotenv("# x\nA=2\nB='q'\n=z\nbad\n", env) == {"B": "q"} and env == {"A": "1", "B": "q"}


def test_keys(spark):
    import hashlib

    row = spark.range(1).select(keys.chapter_key(F.lit("т"), F.lit("x")).alias("k"), keys.chunks_hash(F.array(F.lit("a"), F.lit("b"))).alias("h")).first()
    assert row.k == hashlib.sha1("т\nx".encode()).hexdigest()[:16]
    assert row.h == hashlib.sha1(b"a\n<chunk>\nb").hexdigest()
