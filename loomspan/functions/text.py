"""Text functions of the document model, as columns: empty tokens, names, places, prices, gates and splits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that count as empty, for each consumer; they differ on purpose.
EMPTY_DASHBOARD = ("未识别", "未知", "None", "none", "")
EMPTY_ANALYSIS = ("未识别", "未知", "None", "none", "", "未记载")
EMPTY_INDEX = ("未识别", "未记载", "None", "null", "")
EMPTY_CONTEXT = ("未识别", "未记载", "None", "null", "none", "")
EMPTY_GRAPH = ("未识别", "未知", "None", "未记载", "null", "")
EMPTY_PERSON = ("未识别", "未知", "None", "none", "未记载", "")

# Variants of a character, the standard form last in each group.
VARIANTS = (
    "氏𠂤 佈布 雲云 從从 東东 萬万 與与 義义 書书 會会 來来 備备 價价 處处 問问 國国 園园 報报 壹一 貳二 參叁三 肆四 陸六 柒七 捌八 玖九 拾十 佰百 仟千 "
    "兩两 銀银 錢钱 買买 賣卖 業业 產产 畝亩 陽阳 陰阴 張张 劉刘 陳陈 楊杨 趙赵 黃黄 許许 鄭郑 謝谢 鄧邓 馮冯 蕭萧 鄒邹 嚴严 韓韩 龍龙 盧卢 鍾钟 譚谭 "
    "龔龚 賴赖 閻阎 鄔邬 於于 裏里 縣县 鎮镇 莊庄 廳厅 號号 條条 歲岁 鑑鉴 開开 將将 應应 當当 無无 為为 歸归 議议 據据 總总 繼继 續续 質质 執执 讓让 "
    "認认 證证 憑凭 關关 聯联 齊齐 學学 寳宝 寶宝 塲场 場场 裡里 崑昆 嶽岳 峯峰 甯宁 寕宁 邨村"
).split()

# Surnames of two characters.
COMPOUND_SURNAMES = "欧阳 太史 端木 上官 司马 东方 独孤 南宫 万俟 闻人 夏侯 诸葛 尉迟 公羊 赫连 澹台 皇甫 宗政 濮阳 公冶 太叔 申屠 公孙 慕容 仲孙 钟离 长孙 宇文 司徒 鲜于 司空 令狐".split()

# Endings of a place name that say nothing, in the order in which they are taken off.
PLACE_ENDINGS = ("地方", "处", "處", "地")

# Characters of numerals and what they stand for.
NUMERALS = dict(zip("零〇一壹二贰貳三叁參四肆五伍六陆陸七柒八捌九玖十拾百佰千仟万萬", (0, 0, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 5, 5, 6, 6, 6, 7, 7, 8, 8, 9, 9, 10, 10, 100, 100, 1000, 1000, 10000, 10000), strict=True))

# Phrases of standard wording.
TEMPLATE_PHRASES = "今因移就 三面言定 親手領訖 任從買主 陰陽兩便 百為無阻 恐口無憑 立此為據 永遠為業".split()

PLACEHOLDER = "□"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def as_text(value: Column) -> Column:
    """A value as the text that a missing one turns into when it is printed."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def is_empty(value: Column, tokens: tuple[str, ...] = EMPTY_ANALYSIS) -> Column:
    return value.isNull() | F.trim(value).isin(*tokens)


def present(value: Column, tokens: tuple[str, ...]) -> Column:
    """The trimmed value, or an empty text for an empty token."""
    return F.when(is_empty(value, tokens), F.lit("")).otherwise(F.trim(value))


def normal_chars(value: Column) -> Column:
    """Variant characters replaced by their standard form, in one pass."""
    pairs = {c: group[-1] for group in VARIANTS for c in group[:-1]}
    return F.translate(value, "".join(pairs), "".join(pairs.values()))


def normal_place(value: Column) -> Column:
    """A place in standard characters without endings that say nothing; each is taken off once, if something remains."""

    def without(ending: str) -> Callable[[Column], Column]:
        return lambda x: F.when(x.endswith(F.lit(ending)) & (F.length(x) > len(ending)), F.left(x, F.length(x) - len(ending))).otherwise(x)

    return reduce(lambda out, ending: let(out, without(ending)), PLACE_ENDINGS, normal_chars(F.trim(value)))


# Fixed value: what stands between names in one field.
PEOPLE_SEPARATORS = r"[、，,；;]\s*|(?:以?及|和|与|與)\s*"


def split_people(value: Column) -> Column:
    """The names in a field that may hold several, without empty tokens."""
    parts = F.split(F.trim(F.coalesce(value, F.lit(""))), PEOPLE_SEPARATORS)
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: ~p.isin(*EMPTY_PERSON))


def surname(name: Column) -> Column:
    return F.when(F.substring(name, 1, 2).isin(*COMPOUND_SURNAMES), F.substring(name, 1, 2)).otherwise(F.substring(name, 1, 1))


def numeral(text: Column) -> Column:
    """The number that a run of numeral characters says: a digit waits for its unit; a unit alone counts one of it."""
    codes = F.create_map(*[F.lit(x) for pair in NUMERALS.items() for x in pair])
    digits = F.filter(F.transform(F.split(text, ""), lambda c: codes[c]), lambda v: v.isNotNull())
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("digit"))
    return F.aggregate(
        digits,
        start,
        lambda acc, v: F.when(v >= 10, F.struct((acc.total + F.when(acc.digit == 0, 1).otherwise(acc.digit) * v).alias("total"), F.lit(0).alias("digit"))).otherwise(F.struct(acc.total.alias("total"), v.alias("digit"))),
        lambda acc: acc.total + acc.digit,
    )


def first_number(text: Column) -> Column:
    """The first run of digits with an optional fraction, as a double; null without one."""
    return F.when(text.rlike(r"[0-9]"), F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)", 1).cast("double"))


def price(text: Column) -> Column:
    """A price in taels: the first number, or else numerals before 两 plus a tenth of those before 钱; null if neither."""
    chars = "".join(NUMERALS)
    small = "".join(c for c, v in NUMERALS.items() if v <= 10)
    taels = F.regexp_extract(text, rf"([{chars}]+)\s*两", 1)
    mace = F.regexp_extract(text, rf"([{small}]+)\s*钱", 1)
    total = let(taels, lambda x: F.when(x != "", numeral(x)).otherwise(0)) + let(mace, lambda x: F.when(x != "", numeral(x)).otherwise(0)) * F.lit(0.1)
    return F.when(is_empty(text), None).when(text.rlike("[0-9]"), first_number(text)).otherwise(let(total, lambda x: F.when(x > 0, x)))


def chosen_text(raw: Column, corrected: Column, human: Column, *, trim_raw: bool = True) -> Column:
    """The corrected text if a person corrected it and it isn't blank, else the raw one."""
    fallback = F.coalesce(raw, F.lit(""))
    return F.when(F.coalesce(human, F.lit(False)) & (F.trim(F.coalesce(corrected, F.lit(""))) != ""), F.trim(corrected)).otherwise(F.trim(fallback) if trim_raw else fallback)


def visible_length(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", ""))


def single_visible(text: Column) -> Column:
    """Whether a text is a single character of a document: a digit or CJK."""
    return F.coalesce(text, F.lit("")).rlike(r"^[0-9\x{4e00}-\x{9fff}]$")


def too_long(text: Column, expected: int = 420) -> Column:
    """The reason for which a text is rejected by length, or null."""
    most = int(expected * 1.4)
    return F.when(visible_length(text) > most, F.concat(F.lit("hard_reject:too_long:"), visible_length(text).cast("string"), F.lit(f">{most}")))


def template_density(text: Column) -> Column:
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")
    hits = reduce(lambda a, b: a + b, [clean.contains(p).cast("int") for p in TEMPLATE_PHRASES])
    return F.when(F.length(clean) == 0, F.lit(0.0)).otherwise(hits / F.greatest(F.length(clean) / 120, F.lit(1.0)))


def filtered_text(fused: Column, trusted: Column, confidence: Column, agreed: Column) -> tuple[Column, Column]:
    """(text, reasons) after the filters of invented text; `agreed` replaces the trusted text where both models disagree widely."""
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", "")
    extra = F.when(F.length(clean(fused)) == 0, F.lit(0.0)).otherwise(F.greatest(F.length(clean(fused)) - F.length(clean(trusted)), F.lit(0)) / F.length(clean(fused)))
    density = template_density(fused)
    hard = F.array_compact(F.array(too_long(fused), F.when(extra > 0.12, F.format_string("hard_reject:v3_only_ratio:%.2f>0.12", extra)), F.when((density >= 5) & (confidence < 0.75), F.format_string("hard_reject:template_density:%.2f", density))))
    low = (F.size(hard) == 0) & (clean(fused) != "") & (confidence < 0.45)
    reasons = F.when(low, F.array(F.format_string("hard_reject:low_model_agreement:%.2f<0.45", confidence))).otherwise(hard)
    return F.when(low, agreed).when(F.size(hard) > 0, trusted).otherwise(fused), reasons


def usable(text: Column, left: Column, right: Column, width: Column) -> Column:
    """Text of a document: not blank, no Latin letter, no short number at the edge of the image, half of it at least CJK or digits."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")
    edge = clean.rlike(r"^[0-9]{1,5}$") & ((left < width * 0.08) | (right > width * 0.92))
    share = F.length(F.regexp_replace(clean, r"[^0-9㐀-䶿一-鿿豈-﫿]", "")) / F.length(clean)
    return (clean != "") & ~clean.rlike("[A-Za-z]") & ~edge & (share >= 0.5)


def fold_of(key: Column, fixed: tuple[str, ...] = ()) -> Column:
    """The split of a key: named ones are for regression; else its SHA-256 modulo 5, which is its digit sum (16 is 1 modulo 5)."""
    digits = F.split(F.sha2(key, 256), "")
    total = F.aggregate(digits, F.lit(0).cast("bigint"), lambda acc, c: acc + F.coalesce(F.conv(F.when(c != "", c), 16, 10).cast("bigint"), F.lit(0)))
    return F.when(key.isin(*fixed), "regression").when(total % 5 == 0, "test").when(total % 5 == 1, "dev").otherwise("audit")


def natural_key(text: Column, separator: str = "·") -> Column:
    """The numbers of a key like 3·141, to sort by."""
    return F.transform(F.split(text, separator), lambda x: x.try_cast("int"))
