"""Text expressions: cleaning, language, sentences, tokens. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.columns import trimmed

CJK = "\\u4e00-\\u9fff"
# Surnames, and endings of places and organisations, longer ones first.
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱林郭何高郑罗梁谢宋唐许邓肖冯韩曹彭曾田董潘袁于蒋蔡余杜苏吕丁沈任姚卢傅钟姜崔谭廖范"
PLACES = sorted("省 市 区 县 镇 乡 村 街 路 道 号 大厦 广场 中心 酒店 饭店 餐厅 商场 超市 公园 景区 北京 上海 广州 深圳 杭州 南京 武汉 成都 重庆".split(), key=len, reverse=True)
BODIES = sorted("公司 集团 有限 股份 科技 网络 技术 软件 数据 银行 保险 证券 基金 大学 学院 医院 研究院 政府 局 部 委 办 处 科 中心 协会 学会 商会 联盟 组织 机构 平台 媒体 报社 出版社".split(), key=len, reverse=True)
# Small stop-word lists, and words of feeling and denial.
STOP_EN = "a an and are as at be been but by can did do does for from had has have he her his i if in into is it its me my no not of on or our she so than that the their them then there these they this to was we were what when which who will with would you your".split()
STOP_ZH = list("的了在是我有和就不人都一个上也很到说要去你会着没看好自己这那")
POSITIVE = "good great excellent perfect awesome amazing fantastic nice lovely beautiful wonderful superb outstanding happy pleased satisfied delighted grateful love like recommend support value fast quick easy simple clean clear stable cheap affordable worth best favorite".split()
NEGATIVE = "bad terrible awful horrible poor worse worst disappointed disappointing frustrated annoying hate dislike complaint issue problem broken damaged defective faulty slow lag crash freeze expensive overpriced fake fraud scam useless waste".split()
DENIAL = "no not never none cannot cant dont doesnt didnt wont isnt arent wasnt".split()
POSITIVE_ZH = "好 不错 满意 喜欢 赞 棒 优秀 出色 精彩 完美 开心 高兴 愉快 幸福 感激 感谢 支持 推荐 值得 良心 厚道 贴心 周到 专业 高效 快速 便宜 实惠 性价比 超值 给力 牛逼 厉害 强大 先进 创新 清晰 流畅 稳定 耐用 美观 大气 时尚 舒适 环保 健康 安全 放心 靠谱 可信 真诚 热情".split()
NEGATIVE_ZH = "差 差劲 糟糕 失望 讨厌 恨 垃圾 烂 恶心 难过 伤心 痛苦 愤怒 生气 抱怨 投诉 退款 退货 问题 毛病 故障 卡顿 闪退 死机 慢 贵 昂贵 坑 骗 假 劣质 粗糙 简陋 难用 麻烦 繁琐 混乱 差评 黑心 无良 虚假 欺骗 忽悠 敷衍 拖延 推诿".split()
DENIAL_ZH = "不 没 无 非 莫 勿 别 未 不是 没有".split()


def clean(c: Column, unicode_letters: bool = False) -> Column:
    """Without tags, addresses and odd characters; runs of blanks become one. Accented letters go too, unless asked."""
    out = F.regexp_replace(c, "<[^>]+>", "")
    out = F.regexp_replace(out, r"https?://\S+|www\.\S+", "")
    out = F.regexp_replace(out, r"\S+@\S+\.\S+", "")
    letters = r"\p{L}\p{N}" if unicode_letters else f"{CJK}a-zA-Z0-9"
    out = F.regexp_replace(out, f"[^{letters}" + r"\s.,!?;:'\"()-]", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def language(c: Column) -> Column:
    """zh where over three tenths are CJK, en where any Latin letter is, else unknown."""
    cjk = F.length(F.regexp_replace(c, f"[^{CJK}]", ""))
    return F.when(F.try_divide(cjk.cast("double"), F.length(c)) > 0.3, "zh").when(c.rlike("[a-zA-Z]"), "en").otherwise("unknown")


def sentences(c: Column, aggressive: bool = False) -> Column:
    """Pieces that end with a mark (kept), or at a line end; aggressive also ends them at commas and the like."""
    marks = "。！？.!?；;，,、：:\n" if aggressive else "。！？.!?\n"
    found = F.regexp_extract_all(c, F.lit(f"[^{marks}]+[{marks}]?"), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(F.regexp_replace(s, "\n", ""))), lambda s: F.length(s) > 0)


def _plain(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"\s+"), lambda t: F.length(t) > 0)


def tokens(c: Column) -> Column:
    """Lower-case pieces between white space; runs of CJK characters in them become their neighbouring pairs,
    without the marks beside them."""
    plain = _plain(c)
    runs = F.flatten(F.transform(plain, lambda t: F.regexp_extract_all(t, F.lit(f"^[^{CJK}]+$|[{CJK}]+|[^{CJK}\\p{{P}}\\p{{S}}]+"), F.lit(0))))
    return F.when(c.rlike(f"[{CJK}]"), F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"[{CJK}]"), bigrams_cjk(r)).otherwise(F.array(r))))).otherwise(plain)


def sentence_words(c: Column) -> Column:
    """The tokens of each sentence, without the marks in them; a text is asked once whether it has CJK characters."""
    bare = F.transform(sentences(c), lambda x: F.regexp_replace(x, r"[\p{Punct}。！？，]", " "))
    return F.when(c.rlike(f"[{CJK}]"), F.transform(bare, tokens)).otherwise(F.transform(bare, _plain))


def bigrams_cjk(c: Column) -> Column:
    """Neighbouring CJK characters: tokens without a segmenter."""
    chars = F.regexp_extract_all(c, F.lit(f"[{CJK}]"), F.lit(0))
    return F.when(F.size(chars) > 1, F.transform(F.sequence(F.lit(1), F.size(chars) - 1), lambda i: F.concat(F.element_at(chars, i), F.element_at(chars, i + 1)))).otherwise(chars)


def without_stop_words(t: Column, extra: list[str] = ()) -> Column:
    stop = [*STOP_EN, *STOP_ZH, *extra]
    return F.filter(t, lambda w: ~w.isin(stop) & (F.length(F.trim(w)) > 1))


def noise_line(line: Column, repeated: str | None = None) -> Column:
    """Lines of numbers, codes, marks or one character over and over, and short ones. repeated: the characters that are
    noise over and over, where it is not all."""
    over = r"(.)\1{5,}" if repeated is None else "([" + "".join(f"\\x{{{ord(x):x}}}" for x in repeated) + r"])\1{5,}"
    return (F.length(trimmed(line)) < 20) | line.rlike(r"^[0-9 \t\n\f\r.,%+-]+\z") | line.rlike(r"^[ \t\n\f\r]*[06][0-9]{5}[ \t\n\f\r]*\z") | line.rlike(r"^[^\p{L}\p{N}]+\z") | line.rlike(over)


def without_noise(c: Column, repeated: str | None = None) -> Column:
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~noise_line(x, repeated)), "\n")


def filtered_tokens(t: Column) -> Column:
    """Without numbers, codes, dates, amounts with units, Latin pieces of two letters or fewer, and pieces without letters."""
    return F.filter(
        t,
        lambda w: ~(w.rlike(r"^\d+(\.\d+)?$") | w.rlike(r"^[06]\d{5}$") | w.rlike(r"^\d{4}[-/.]?\d{0,2}[-/.]?\d{0,2}$") | w.rlike(r"^\d+(\.\d+)?[a-z%]{1,3}$") | w.rlike(r"^[a-zA-Z]{1,2}$") | ~w.rlike(rf"[a-zA-Z{CJK}À-ɏ]")),
    )


def ngrams(t: Column, n: int, joined: str = "") -> Column:
    """Runs of n tokens. The tokens are bound to a variable of a lambda: they are computed once, not once a run."""

    def runs(v: Column) -> Column:
        return F.when(F.size(v) >= n, F.transform(F.sequence(F.lit(1), F.size(v) - (n - 1)), lambda i: F.array_join(F.slice(v, i, n), joined))).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(t), runs), 0)


def sentiment(c: Column) -> Column:
    """struct(positive, negative, label, confidence). In a sentence a word of denial turns every later hit into half a
    hit against its side; a sentence's scores are not under 0. Where over a fifth of the characters are CJK the Chinese
    words count, the longest where several begin at one place, else the English ones."""
    chinese = F.coalesce(F.try_divide(F.length(F.regexp_replace(c, f"[^{CJK}]", "")).cast("double"), F.length(c)) > 0.2, F.lit(False))
    lexicon = sorted({*POSITIVE_ZH, *NEGATIVE_ZH, *DENIAL_ZH}, key=lambda w: (-len(w), w))

    def step(acc: Column, w: Column) -> Column:
        hit = F.when(acc["n"], F.lit(-0.5)).otherwise(F.lit(1.0))
        return F.struct((acc["p"] + F.when(w.isin([*POSITIVE, *POSITIVE_ZH]), hit).otherwise(0.0)).alias("p"), (acc["q"] + F.when(w.isin([*NEGATIVE, *NEGATIVE_ZH]), hit).otherwise(0.0)).alias("q"), (acc["n"] | w.isin([*DENIAL, *DENIAL_ZH])).alias("n"))

    start = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("q"), F.lit(False).alias("n"))
    zero = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
    latin = lambda s: F.transform(F.regexp_extract_all(F.lower(s), F.lit("[a-z']+"), F.lit(0)), lambda w: F.replace(w, F.lit("'"), F.lit("")))
    cjk = lambda s: F.regexp_extract_all(s, F.lit("|".join(lexicon)), F.lit(0))

    def total(words) -> Column:
        each = F.transform(sentences(c), lambda s: F.aggregate(words(s), start, step, lambda a: F.struct(F.greatest(a["p"], F.lit(0.0)).alias("p"), F.greatest(a["q"], F.lit(0.0)).alias("q"))))
        return F.aggregate(each, zero, lambda a, x: F.struct((a["p"] + x["p"]).alias("p"), (a["q"] + x["q"]).alias("q")))

    def told(a: Column) -> Column:
        p, q = a["p"], a["q"]
        label = F.when(p > q, "positive").when(q > p, "negative").otherwise("neutral")
        return F.struct(p.alias("positive"), q.alias("negative"), label.alias("label"), F.least(F.abs(p - q) / F.greatest(p, q, F.lit(1.0)), F.lit(1.0)).alias("confidence"))

    # bound to a variable of a lambda, the totals are computed once for all four fields
    return F.get(F.transform(F.array(F.when(chinese, total(cjk)).otherwise(total(latin))), told), 0)


def entities_latin(c: Column) -> Column:
    """Runs of capitalised words."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b(?:[A-Z][a-z]+)(?:\s+[A-Z][a-z]+)*\b"), F.lit(0)))


def entities_cjk(c: Column) -> Column:
    """A surname and one or two characters before a mark or an end, and runs up to the ending of a place or organisation."""
    rules = [f"[{SURNAMES}][{CJK}]{{1,2}}(?=[，。！？；：\\s]|$)", *[f"[{CJK}]+?(?:{'|'.join(ends)})" for ends in (PLACES, BODIES)]]
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(c, F.lit(r), F.lit(0)) for r in rules])))


def entities(c: Column) -> Column:
    """Those of both scripts."""
    return F.when(c.rlike(f"[{CJK}]"), F.array_union(entities_latin(c), entities_cjk(c))).otherwise(entities_latin(c))
