"""Sections and summary table of the written protocol, from one-row tables of a record. The sentences are fixed texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clock, decimal_comma, plural, spaced


def number(c: str | Column, digits: int = 0) -> Column:
    value = F.col(c).cast("double") if isinstance(c, str) else c
    return F.when(value.isNull(), "—").otherwise(F.format_string(f"%.{digits}f", value))


def density(share: Column) -> Column:
    """How dense ectopic beats are, by their share of all in percent."""
    known = F.when(share < 0.1, "единичная").when(share < 1, "редкая").when(share < 10, "умеренно частая").when(share < 20, "частая").otherwise("очень частая")
    return F.when(share.isNull(), "—").otherwise(known)


def length(ms: Column) -> Column:
    """Whole days count as hours."""
    return F.concat(F.floor(ms / 3600000), F.lit(" ч "), F.floor(ms / 60000) % 60, F.lit(" мин"))


def real_episodes(episodes: DataFrame) -> DataFrame:
    """(record_id, pairs, groups, s_runs, longest) of the episodes that are no artifacts; longest: of the pauses, in ms."""
    return episodes.filter("verdict <> 'artifact'").groupBy("record_id").agg(
        F.count_if(F.expr("kind = 'v-run' and k1 - k0 = 1")).alias("pairs"), F.count_if(F.expr("kind = 'v-run' and k1 - k0 >= 2")).alias("groups"),
        F.count_if(F.expr("kind = 's-run'")).alias("s_runs"), F.max(F.expr("case when kind = 'pause' then dur_ms end")).alias("longest"),
    )


def summary_rows(records: DataFrame, summary: DataFrame, hrv: DataFrame, mean: DataFrame, episodes: DataFrame) -> DataFrame:
    """(record_id, place, k, v, n): the lines of the summary table, a name, a value and a note each.

    records: record_id, start. summary: see operators.views. A figure that a record lacks is a dash; counts it lacks are 0.
    """
    x = summary.join(records.select("record_id", "start"), "record_id")
    for t in (hrv.drop("n"), mean, real_episodes(episodes)):
        x = x.join(t, "record_id", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    at = lambda c: F.coalesce(clock(F.col("start"), F.col(c) * 1000), F.lit("—"))
    percent = lambda c: F.try_divide(100.0 * count(c), F.col("beats"))
    circadian = F.try_divide(F.rint("day"), F.rint("night"))
    worst = F.when(count("pauses_real") > 0, F.concat(F.lit("максимальная "), number(F.col("longest") / 1000, 1), F.lit(" с"))).otherwise("нет")
    false = count("pauses_device") - count("pauses_real")
    noisy = F.when(false > 0, F.concat(F.lit("; "), false, F.lit(" у прибора — помехи"))).otherwise("")
    lines = [
        ("Длительность записи", [length(F.col("duration_s") * 1000)], ["комплексов ", spaced(F.col("beats"))]),
        ("ЧСС средняя / мин / макс", [number("hr"), " / ", number("hr_min"), " / ", number("hr_max"), " уд/мин"], ["мин. в ", at("min_at_s"), ", макс. в ", at("max_at_s")]),
        ("ЧСС днём / ночью", [number("day"), " / ", number("night"), " уд/мин"], ["циркадный индекс ", number(circadian, 2)]),
        ("Вариабельность (SDNN / RMSSD)", [number("sdnn"), " / ", number("rmssd"), " мс"], ["pNN50 ", number("pnn50", 1), "%"]),
        ("Желудочковые экстрасистолы", [count("kept_v")], [number(percent("kept_v"), 2), "%, ", density(percent("kept_v")), "; парных ", count("pairs"), ", групповых ", count("groups")]),
        ("Наджелудочковые экстрасистолы", [count("kept_s")], [number(percent("kept_s"), 2), "%, ", density(percent("kept_s")), "; групповых ", count("s_runs")]),
        ("Паузы более 2 с", [count("pauses_real")], [worst, noisy]),
        ("Чистый сигнал", [number("clean_pct", 1), "%"], ["по независимым каналам, окна по 2 с"]),
    ]
    text = lambda parts: decimal_comma(F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]))
    table = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("k"), text(v).alias("v"), text(n).alias("n")) for i, (k, v, n) in enumerate(lines)])
    return x.select("record_id", F.inline(table))


#: The sections' keys in their order, and sentences that hold no figures
SECTIONS = ("rhythm", "ventricular", "supraventricular", "brady", "conduction", "intervals", "symptoms", "quality", "resume", "recommendations")
CONDUCTION = "; оценка по зубцам P за врачом. АВ-проводимость по автоматическим данным не оценивается: без разметки зубцов P блокады II–III степени исключаются только визуально."
NO_PQ = "Интервал PQ автоматически не измеряется: зубец P мельче уровня помех отведения и различим только на усреднённом комплексе, где его начало смещается до 70 мс от выбора правила; оценка — по фрагментам. "
NO_QT = "Интервал QT измерить не удалось: усреднённый комплекс не набрался. "
QT_SHORT, QT_LONG = "Удлинения QTc свыше 480 мс не зарегистрировано. ", "Зарегистрированы часы с QTc свыше 480 мс — требуется просмотр врачом. "
NO_ST = "Сегмент ST: смещения в милливольтах не оцениваются, масштаб напряжения экспорта не калиброван."
NO_DIARY = "Дневник пациента не заполнен; сопоставление симптомов с ритмом не проводилось."
NO_GAIN = "Масштаб напряжения экспорта не калиброван: амплитуды на фрагментах приведены без масштаба, смещение ST, амплитуда T и вольтаж не оценивались; на длительности, в том числе на QT, масштаб не влияет."
REJECTED = " при проверке (двойной счёт, метки вне QRS, синусовая морфология, помехи)."
LOST = " при проверке — потеря сигнала (отклеенный электрод, помеха), не асистолия."


def said(*parts: Column | str) -> Column:
    """The parts one after another; a figure that is null is a dash."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("—")) for p in parts))


def where(condition: Column, *parts: Column | str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), said(*parts)).otherwise("")


def counted(n: Column, *forms: str) -> Column:
    return said(n, " ", plural(n, *forms))


def whole(c: str) -> Column:
    """A figure as whole number; halves go to the even one."""
    return F.bround(F.col(c).cast("double")).cast("long")


def episode_lists(episodes: DataFrame, records: DataFrame) -> DataFrame:
    """(record_id, v_groups, s_groups, pauses, longest, longest_t): the real runs of three V and more, and of S, as they are listed, and the pauses."""
    real = episodes.filter("verdict <> 'artifact'").join(records.select("record_id", "start"), "record_id")
    at = clock(F.col("start"), F.col("t_ms"))
    line = F.when(F.expr("kind = 'v-run' and k1 - k0 >= 2"), said(at, " ×", F.expr("k1 - k0 + 1"))).when(F.col("kind") == "s-run", said(at, " ", F.col("title")))
    listed = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & line.isNotNull(), F.struct("t_ms", "id", line.alias("line"))))), lambda x: x["line"]), ", ")
    pause = F.when(F.col("kind") == "pause", F.struct("dur_ms", -F.col("id")))
    return real.groupBy("record_id").agg(
        listed("v-run").alias("v_groups"), listed("s-run").alias("s_groups"), F.count_if(F.col("kind") == "pause").alias("n_pauses"), F.max(F.when(F.col("kind") == "pause", F.col("dur_ms"))).alias("longest"), F.max_by("t_ms", pause).alias("longest_t")
    )


def diary_lines(events: DataFrame, records: DataFrame) -> DataFrame:
    """(record_id, diary): a line per entry, of what the rhythm did around it."""
    some = lambda name, c: F.when(F.col(c) > 0, said(f"{name} ", F.col(c))).otherwise(f"{name} нет")
    rate = F.when(F.col("hr").isNotNull(), said("ЧСС ", whole("hr"), " (", whole("hr_min"), "–", whole("hr_max"), ") уд/мин"))
    many = F.when(F.col("episodes") > 0, counted(F.col("episodes"), "эпизод", "эпизода", "эпизодов"))
    noisy = F.when(F.col("noise") >= 0.5, F.lit("помеха на записи"))
    what = F.concat_ws(", ", rate, some("ЖЭС", "v"), some("НЖЭС", "s"), many, noisy)
    told = F.when(F.col("text") != "", F.col("text")).otherwise("симптом")
    line = said(clock(F.col("start"), F.col("t_ms")), " — ", told, ": в пределах ±2 мин ", what, ".")
    rows = events.join(records.select("record_id", "start"), "record_id").withColumn("line", line)
    return rows.groupBy("record_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t_ms", "id", "line"))), lambda x: x["line"]), "\n").alias("diary"))


def sections(
    records: DataFrame, summary: DataFrame, mean: DataFrame, hrv: DataFrame, minutes: DataFrame, episodes: DataFrame, morphologies: DataFrame, circadian_v: DataFrame, circadian_s: DataFrame, kept_in: DataFrame, criteria: DataFrame, qt: DataFrame, events: DataFrame, edits: DataFrame
) -> DataFrame:
    """(record_id, place, key, text): the written protocol's sections, one row each, of tables with a row per record or more.

    summary, mean, hrv, edits: a row per record. minutes: with asleep. qt: see intervals.qt_summary. events: see edits.event_context. A figure that a
    record lacks is a dash, a count it lacks 0.
    """
    inside = kept_in.groupBy("record_id").agg(F.sum(F.when(F.col("kind") == "v-run", F.col("n"))).alias("in_v"), F.sum(F.when(F.col("kind") == "s-run", F.col("n"))).alias("in_s"))
    shapes = morphologies.groupBy("record_id").agg(F.count("*").alias("shapes"))
    irregular = criteria.filter("key = 'af'").select("record_id", F.coalesce("value", F.lit(0)).cast("long").alias("irregular"))
    x = summary.join(records.select("record_id", "start"), "record_id")
    parts = (
        mean.select("record_id", "hr"), hrv.drop("n"), real_episodes(episodes).drop("longest"), episode_lists(episodes, records), shapes, circadian_v.select("record_id", F.col("circadian").alias("type_v")), circadian_s.select("record_id", F.col("circadian").alias("type_s")),
        inside, irregular, qt, diary_lines(events, records), edits,
    )
    for t in parts:
        x = x.join(t, "record_id", "left")
    x = x.withColumn("low_m", F.expr("min_at_s div 60")).join(minutes.select("record_id", F.col("m").alias("low_m"), F.col("asleep").alias("low_asleep")), ["record_id", "low_m"], "left")
    for c in ("kept_v", "v_likely", "kept_s", "pairs", "groups", "s_runs", "n_pauses", "shapes", "in_v", "in_s", "irregular", "manual", "added", "quality_spans", "pauses_device"):
        x = x.withColumn(c, F.coalesce(c, F.lit(0)))
    col = F.col
    at = lambda c: clock(col("start"), col(c) * 1000)
    index = F.try_divide(whole("day").cast("double"), whole("night").cast("double"))
    share_v, share_likely, share_s = (F.try_divide(100.0 * col(c), col("beats")) for c in ("kept_v", "v_likely", "kept_s"))
    length_min = F.bround(col("duration_s") / 60).cast("long")
    circadian = lambda c: F.when(F.coalesce(col(c), F.lit("")) != "", said(", циркадный тип ", col(c), ". ")).otherwise(". ")
    capital = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 100))
    texts = {}
    texts["rhythm"] = said(
        "Мониторирование длилось ", F.floor(length_min / 60), " ч ", F.lpad((length_min % 60).cast("string"), 2, "0"), " мин, проанализировано ", col("beats"), " комплексов. Основной ритм синусовый. ЧСС средняя за сутки ", whole("hr"), " уд/мин, минимальная ", whole("hr_min"), " уд/мин (", at("min_at_s"),
        "), максимальная ", whole("hr_max"), " уд/мин (", at("max_at_s"), "). Средняя дневная ", whole("day"), ", средняя ночная ", whole("night"), " уд/мин", where(index.isNotNull(), "; циркадный индекс ", number(index, 2), " (норма 1,22–1,45)"), ". Тахикардия свыше 100 уд/мин ", number("pct_over_100", 1),
        "% времени, брадикардия ниже 50 уд/мин ", number("pct_under_50", 1), "%. Вариабельность ритма: SDNN ", number("sdnn"), " мс, RMSSD ", number("rmssd"), " мс, pNN50 ", number("pnn50", 1), "%.",
    )
    low, high = number(share_likely, 2), number(share_v, 2)
    rejected = col("device_v") - col("kept_v")
    texts["ventricular"] = said(
        "Желудочковая экстрасистолия ", density(share_v), ": ", col("v_likely"), "–", col("kept_v"), " за сутки (", F.when(low == high, said(high, "%")).otherwise(said(low, "–", high, "%")), " комплексов), ",
        F.when(col("shapes") == 1, "мономорфная").when(col("shapes") > 1, said("полиморфная, ", counted(col("shapes"), "морфология", "морфологии", "морфологий"))).otherwise("морфологии не выделены"), circadian("type_v"),
        "Из них одиночных ", F.greatest(F.lit(0), col("kept_v") - col("in_v")), ", парных ", col("pairs"), ", групповых ", col("groups"), ". ", where(col("groups") > 0, "Групповые: ", col("v_groups"), ". "),
        "Прибор насчитал ", col("device_v"), "; ", counted(rejected, "метка отклонена", "метки отклонены", "меток отклонены"), REJECTED,
    )
    texts["supraventricular"] = said(
        "Наджелудочковая экстрасистолия ", density(share_s), ": ", col("kept_s"), " за сутки (", number(share_s, 2), "% комплексов)", circadian("type_s"), "Из них одиночных ", F.greatest(F.lit(0), col("kept_s") - col("in_s")), ", в группах ", col("in_s"), ". ",
        F.when(col("s_runs") > 0, said("Групповые: ", col("s_groups"), ". ")).otherwise("Пароксизмов наджелудочковой тахикардии не зарегистрировано. "), "Прибор насчитал ", col("device_s"), ".",
    )
    lost = col("pauses_device") - col("n_pauses")
    longest = number(col("longest") / 1000, 1)
    texts["brady"] = said(
        "Минимальная ЧСС ", whole("hr_min"), " уд/мин в ", at("min_at_s"), F.when(F.coalesce("low_asleep", F.lit(False)), " (сон). ").otherwise(". "),
        F.when(col("n_pauses") > 0, said(counted(col("n_pauses"), "пауза", "паузы", "пауз"), " более 2 с, максимальная ", longest, " с (", clock(col("start"), col("longest_t")), "). ")).otherwise("Пауз более 2 с не зарегистрировано. "),
        where(lost > 0, counted(lost, "«пауза» прибора", "«паузы» прибора", "«пауз» прибора"), LOST),
    )
    screened = F.when(col("irregular") > 0, said(col("irregular"), " окон по 30 с с нерегулярным ритмом")).otherwise("нерегулярных окон нет")
    texts["conduction"] = said("Фибрилляция предсердий: скрининг по нерегулярности RR — ", screened, CONDUCTION)
    known_qt = said(
        "Интервал QT ", whole("qt_ms"), " мс, корригированный QTc ", whole("qtc_ms"), " мс (по формуле Базетта, усреднённый комплекс ", counted(col("hours"), "час", "часа", "часов"), ", разброс QTc ", whole("qtc_min"), "–", whole("qtc_max"), " мс). ",
        F.when(col("qtc_max") < 480, QT_SHORT).otherwise(QT_LONG),
    )
    texts["intervals"] = said(NO_PQ, F.when(col("qtc_ms").isNotNull(), known_qt).otherwise(NO_QT), NO_ST)
    texts["symptoms"] = F.coalesce("diary", F.lit(NO_DIARY))
    texts["quality"] = said(
        "Чистый сигнал ", col("clean_pct"), "% времени записи. ",
        F.when(col("manual") + col("added") + col("quality_spans") > 0, said("Правки врача: ", counted(col("manual"), "комплекс переразмечен", "комплекса переразмечено", "комплексов переразмечено"), ", ", col("added"), " добавлено, ", counted(col("quality_spans"), "диапазон", "диапазона", "диапазонов"), " качества. "))
        .otherwise("Ручных правок разметки нет. "), NO_GAIN,
    )
    texts["resume"] = said(
        "Синусовый ритм со средней ЧСС ", whole("hr"), " уд/мин (мин. ", whole("hr_min"), ", макс. ", whole("hr_max"), ")", F.when(index.isNotNull(), said(", циркадный индекс ", number(index, 2), ". ")).otherwise(". "), capital(density(share_v)), " ",
        F.when(col("shapes") == 1, "мономорфная ").when(col("shapes") > 1, "полиморфная ").otherwise(""), "желудочковая экстрасистолия (", col("kept_v"), " за сутки)", where(col("pairs") > 0, ", парная (", col("pairs"), ")"), where(col("groups") > 0, ", групповая (", col("groups"), ")"), ". ",
        capital(density(share_s)), " наджелудочковая экстрасистолия (", col("kept_s"), " за сутки)", where(col("s_runs") > 0, ", групповая (", col("s_runs"), ")"), ". ", F.when(col("n_pauses") > 0, said("Паузы до ", longest, " с. ")).otherwise("Пауз более 2 с нет. "),
        F.when(col("irregular") > 0, "Нерегулярный ритм требует оценки по зубцам P.").otherwise("Фибрилляции предсердий по нерегулярности ритма не выявлено."),
    )
    texts["recommendations"] = F.lit("")
    rows = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(key).alias("key"), decimal_comma(texts[key]).alias("text")) for i, key in enumerate(SECTIONS)))
    return x.select("record_id", F.inline(rows))
