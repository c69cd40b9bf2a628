"""Report parts of hand-made records, held against texts written by hand."""

import datetime
import json

from pulseforge.operators import views
from pulseforge.plans import report
from pulseforge.sources.exports import export_json

SUMMARY = "record_id long, duration_s double, beats long, kept_v long, kept_s long, clean_pct double, pauses_device long, pauses_real long, hr_min double, min_at_s long, hr_max double, max_at_s long, night double, day double"
EPISODE = "record_id long, id long, kind string, t_ms long, dur_ms long, verdict string, confidence double, title string, k0 long, k1 long"
START = datetime.datetime(2024, 1, 1, 23, 30)


def episodes(spark):
    rows = [(1, 1, "pause", 0, 2540, "likely", 0.9, "p", 3, 4), (1, 2, "pause", 0, 9000, "artifact", 0.9, "p", 3, 4), (1, 3, "v-run", 0, 500, "likely", 0.9, "v", 5, 6), (1, 4, "v-run", 0, 900, "likely", 0.9, "v", 8, 10), (1, 5, "s-run", 0, 900, "likely", 0.9, "s", 12, 15)]
    return spark.createDataFrame(rows, EPISODE)


def test_summary_rows(spark):
    summary = spark.createDataFrame([(1, 90061.0, 12345, 150, 3, 98.5, 4, 1, 48.2, 3600, 141.6, 7260, 55.4, 80.2), (2, 0.0, 0, None, None, None, None, None, None, None, None, None, None, None)], SUMMARY)
    records = spark.createDataFrame([(1, START), (2, START)], "record_id long, start timestamp_ntz")
    hrv = spark.createDataFrame([(1, 120.3, 35.2, 7.25, 800.0, 9)], "record_id long, sdnn double, rmssd double, pnn50 double, mean_rr double, n long")
    mean = spark.createDataFrame([(1, 75.1)], "record_id long, hr double")
    rows = {(r.record_id, r.place): (r.k, r.v, r.n) for r in report.summary_rows(records, summary, hrv, mean, episodes(spark)).collect()}
    assert [rows[1, i][1:] for i in range(8)] == [
        ("25 ч 1 мин", "комплексов 12 345"),
        ("75 / 48 / 142 уд/мин", "мин. в 00:30, макс. в 01:31"),
        ("80 / 55 уд/мин", "циркадный индекс 1,45"),
        ("120 / 35 мс", "pNN50 7,3%"),
        ("150", "1,22%, умеренно частая; парных 1, групповых 1"),
        ("3", "0,02%, единичная; групповых 1"),
        ("1", "максимальная 2,5 с; 3 у прибора — помехи"),
        ("98,5%", "по независимым каналам, окна по 2 с"),
    ]
    assert [rows[2, i][1:] for i in (0, 1, 4, 6)] == [("0 ч 0 мин", "комплексов 0"), ("— / — / — уд/мин", "мин. в —, макс. в —"), ("0", "—%, —; парных 0, групповых 0"), ("0", "нет")]


def test_header(spark):
    records = spark.createDataFrame([(1, START, "M", 21), (2, START, "F", 112), (3, START, None, None)], "record_id long, start timestamp_ntz, sex string, age long")
    span = spark.createDataFrame([(i, 90061999) for i in (1, 2, 3)], "record_id long, total_ms long")
    counted = spark.createDataFrame([(i, 99226) for i in (1, 2, 3)], "record_id long, beats long")
    rows = {r.record_id: r for r in views.header(records=records, span=span, counted=counted).collect()}
    assert [(rows[i].sex_ru, rows[i].age_ru) for i in (1, 2, 3)] == [("муж.", "21 год"), ("жен.", "112 лет"), ("", "")]
    assert (rows[1].begins, rows[1].ends, rows[1].duration, rows[1].beats) == ("01.01.2024 23:30", "03.01.2024 00:31", "25 ч 1 мин", "99 226")


def test_export_json(spark):
    beats = spark.createDataFrame([(1, 900, "V", "N"), (1, 100, "N", None), (2, 5, "N", "N")], "record_id long, t_ms long, label string, device_label string")
    counts = spark.createDataFrame([(1, "V", "likely", 1)], "record_id long, label string, verdict string, n long")
    criteria = spark.createDataFrame([(1, "pvc", True, 12.5)], "record_id long, key string, met boolean, value double")
    patient = spark.createDataFrame([(1, "M", 21)], "record_id long, sex string, age long")
    diary = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "record_id long, id long, text string")
    made = {r.record_id: json.loads(r.json) for r in export_json(beats, episodes(spark), counts, criteria, {"patient": patient}, {"events": diary}).collect()}
    assert made[1]["patient"] == {"sex": "M", "age": 21} and [e["text"] for e in made[1]["events"]] == ["a", "b"]
    assert [b["t_ms"] for b in made[1]["beats"]] == [100, 900] and len(made[1]["episodes"]) == 5
    assert made[2]["events"] == made[2]["episodes"] == [] and "patient" not in made[2]


def test_sections(spark):
    """Two records: one with all that a protocol tells of, one with nothing."""
    frame = spark.createDataFrame
    records = frame([(1, START), (2, START)], "record_id long, start timestamp_ntz")
    fields = SUMMARY.replace("kept_v long", "device_v long, device_s long, kept_v long, v_likely long") + ", pct_over_100 double, pct_under_50 double"
    summary = frame([(1, 86400.0, 100000, 1600, 12, 1500, 1400, 3, 98.5, 4, 2, 48.2, 3600, 141.6, 7260, 60.4, 80.2, 1.25, 0.0), (2, 0.0, 0, 0, 0, *[None] * 13)][:1] + [(2, 60.0, 10, 0, 0, 0, 0, 0, 100.0, 0, 0, None, None, None, None, None, None, None, None)], fields)
    mean, hrv = frame([(1, 75.1)], "record_id long, hr double"), frame([(1, 120.3, 35.2, 7.25, 800.0, 9)], "record_id long, sdnn double, rmssd double, pnn50 double, mean_rr double, n long")
    minutes = frame([(1, 60, True)], "record_id long, m long, asleep boolean")
    eps = episodes(spark).filter("id <> 1").unionByName(frame([(1, 1, "pause", 3_600_000, 2540, "review", 0.9, "p", 3, 4), (1, 9, "pause", 60_000, 2100, "review", 0.9, "p", 3, 4), (1, 7, "v-run", 120_000, 900, "likely", 0.9, "v", 20, 23)], EPISODE))
    empty = lambda schema: frame([], schema)
    got = {
        (r.record_id, r.key): r.text
        for r in report.sections(
            records, summary, mean, hrv, minutes, eps, frame([(1, 0, 900, 1), (1, 3, 50, 2)], "record_id long, family long, n long, place long"), frame([(1, "ночной")], "record_id long, circadian string"), frame([(1, "")], "record_id long, circadian string"),
            frame([(1, "v-run", 9), (1, "s-run", 3)], "record_id long, kind string, n long"), frame([(1, "af", 2.0), (2, "af", None)], "record_id long, key string, value double"), frame([(1, 400.0, 420.0, 410.0, 490.0, 21)], "record_id long, qt_ms double, qtc_ms double, qtc_min double, qtc_max double, hours long"),
            frame([(1, 2, 7_200_000, "", None, None, None, 0, 2, 0, 0.7), (1, 1, 60_000, "боль", 70.0, 60.0, 90.0, 3, 0, 2, 0.1)], "record_id long, id long, t_ms long, text string, hr double, hr_min double, hr_max double, v long, s long, episodes long, noise double"),
            frame([(1, 21, 1, 2)], "record_id long, manual long, added long, quality_spans long"),
        ).collect()
    }
    assert {k for r, k in got if r == 1} == set(report.SECTIONS) and len(got) == 20
    assert got[1, "rhythm"].startswith("Мониторирование длилось 24 ч 00 мин, проанализировано 100000 комплексов. Основной ритм синусовый. ЧСС средняя за сутки 75 уд/мин, минимальная 48 уд/мин (00:30), максимальная 142 уд/мин (01:31). Средняя дневная 80, средняя ночная 60 уд/мин; циркадный индекс 1,33 (норма 1,22–1,45). ")
    assert got[1, "ventricular"].startswith("Желудочковая экстрасистолия умеренно частая: 1400–1500 за сутки (1,40–1,50% комплексов), полиморфная, 2 морфологии, циркадный тип ночной. Из них одиночных 1491, парных 1, групповых 2. Групповые: 23:30 ×3, 23:32 ×4. Прибор насчитал 1600; 100 меток отклонены при проверке")
    assert got[1, "supraventricular"] == "Наджелудочковая экстрасистолия единичная: 3 за сутки (0,00% комплексов). Из них одиночных 0, в группах 3. Групповые: 23:30 s. Прибор насчитал 12."
    assert got[1, "brady"] == "Минимальная ЧСС 48 уд/мин в 00:30 (сон). 2 паузы более 2 с, максимальная 2,5 с (00:30). 2 «паузы» прибора при проверке — потеря сигнала (отклеенный электрод, помеха), не асистолия."
    assert "2 окон по 30 с" in got[1, "conduction"] and "усреднённый комплекс 21 час, разброс QTc 410–490 мс). Зарегистрированы часы" in got[1, "intervals"]
    assert got[1, "symptoms"] == "23:31 — боль: в пределах ±2 мин ЧСС 70 (60–90) уд/мин, ЖЭС 3, НЖЭС нет, 2 эпизода.\n01:30 — симптом: в пределах ±2 мин ЖЭС нет, НЖЭС 2, помеха на записи."
    assert got[1, "quality"].startswith("Чистый сигнал 98,5% времени записи. Правки врача: 21 комплекс переразмечен, 1 добавлено, 2 диапазона качества. ")
    assert got[1, "resume"] == "Синусовый ритм со средней ЧСС 75 уд/мин (мин. 48, макс. 142), циркадный индекс 1,33. Умеренно частая полиморфная желудочковая экстрасистолия (1500 за сутки), парная (1), групповая (2). Единичная наджелудочковая экстрасистолия (3 за сутки), групповая (1). Паузы до 2,5 с. Нерегулярный ритм требует оценки по зубцам P."
    assert got[2, "symptoms"] == report.NO_DIARY and report.NO_QT in got[2, "intervals"] and "нерегулярных окон нет" in got[2, "conduction"] and "Ручных правок разметки нет. " in got[2, "quality"] and "Пауз более 2 с нет. " in got[2, "resume"]
    assert "ЧСС средняя за сутки — уд/мин, минимальная — уд/мин (—)" in got[2, "rhythm"] and got[2, "recommendations"] == ""
