"""Default lexicons. Every operator takes its lexicon as an argument; these are the defaults."""

from __future__ import annotations

# KPI label patterns, tried in this order.
KPI_LABELS = (
    ("извлечение / выход", r"извлечени\w+|выход\w+|recovery|yield|extraction"),
    ("прочность", r"прочност\w+|strength|tensile|hardness"),
    ("жаропрочность", r"жаропроч\w+|heat.?resist"),
    ("себестоимость", r"себестоим\w+|cost|opex|capex"),
    ("качество", r"качеств\w+|grade|purity|чистот"),
    ("эффективность", r"эффективн\w+|efficien\w+|performance"),
    ("срок службы", r"срок\s+служб|durability|lifetime|fatigue"),
    ("вязкость / реология", r"вязкост\w+|viscosity|rheolog"),
    ("адгезия / покрытие", r"адгези\w+|покрыти\w+|coating|adhesion"),
    ("проводимость", r"проводим\w+|conductiv"),
    ("плотность / пористость", r"плотност\w+|порист\w+|density|porosity"),
    ("токсичность / экология", r"токсичн\w+|эколог\w+|emission|toxic"),
)
DEFAULT_KPI_LABEL = "целевой KPI"

# Predicate patterns over hypothesis texts.
VALUE_LINK = (
    r"извлечени|себестоим|прочност|жаропроч|kpi|эффективн|повышени|снижени|оптимизац|результат|целев|улучшени|"
    r"recovery|yield|strength|efficien\w+|quality|performance|cost|durability|conductiv|adhesion|viscosity|density"
)
TESTABLE_ACTION = (
    r"повысит|повышени|снизит|снижени|улучшит|улучшени|обеспечит|позволит|увеличит|оптимизир|достигнет|"
    r"изменит|заменит|модернизир|переведёт|переведет|increase|decrease|improve|enhance|reduce|optimize|achieve"
)
INTERVENTION = (
    r"изменени|замен|модерниз|установк|оптимизац|перестрой|реконструкц|увеличени|снижени|перевод|переключ|"
    r"повысит|снизит|улучшит|увеличит|добавлени|введени|состав|сплав|полимер|композит|реагент|добавк|"
    r"equipment|process|alloy|polymer|composite|additive|temperature|pressure|concentration|dosage|режим|mode"
)
CONCRETE = (
    r"геометри|конфигурац|конструкц|диаметр|крупност|зазор|частот|скорост|схем|режим|класс|"
    r"composition|parameter|concentration|dosage|temperature|pressure|thickness"
)
MEASURABLE = (
    r"\d+[\.,]?\d*\s*%",
    r"\d+[\.,]?\d*\s*(кг|г|т|мг|л|мл|ppm|ppb|моль|mol)\b",
    r"\d+[\.,]?\d*\s*кг\s*/\s*т",
    r"pH\s*\d",
    r"\d+[\.,]?\d*\s*[-–—]\s*\d+",
    r"\d+[\.,]?\d*\s*(мм|мкм|см|м\b|нм|об/мин|rpm|кВт|МПа|бар|°C|K|В|А|ГПа)\b",
    r"(?:с|от)\s*\d+\s*(?:на|до|to)\s*\d+",
    r"\d+\s*(?:→|->)\s*\d+",
    r"\d+[\.,]?\d*\s*(wt\.?%|vol\.?%|at\.?%)",
    r"(?:≥|<=?|>=?)\s*\d+[\.,]?\d*",
)
TEXT_PARAMETERS = (
    ("pH", r"pH\s*[:=]?\s*(\d+(?:\.\d+)?)"),
    ("dosage", r"(\d+(?:\.\d+)?)\s*(?:кг|г|wt\.?%|vol\.?%)\s*/?\s*(?:т|wt)?"),
    ("temperature", r"(?:температур\w*|temperature)\s*[:=]?\s*(\d+(?:\.\d+)?)"),
    ("pressure", r"(?:давлен\w*|pressure)\s*[:=]?\s*(\d+(?:\.\d+)?)"),
    ("metric", r"(?:извлечени\w*|recovery|yield|strength|efficien\w*)\s*[:=]?\s*(\d+(?:\.\d+)?)"),
)

# Words that are no topics.
TOPIC_STOP = (
    "повышение", "снижение", "оптимизация", "гипотеза", "эксперимент", "исследование", "результат", "процесс",
    "материал", "свойство", "improvement", "increase", "decrease", "process", "material",
)
GAP_STOP = (
    "повышение", "повышени", "оптимизации", "оптимизац", "капитальных", "вложений", "режима", "хвостов", "извлечения",
    "существующего", "оборудования", "ограничения", "ограничений", "задачи", "процесса", "процесс", "меди", "медь", "кгмк",
)
GAP_TOPICS = (
    ("pH", r"pH|щелоч|кислот"),
    ("реагенты", r"реагент|собирател|депрессант|кмц|ксантогенат"),
    ("извлечение", r"извлечени|recovery|выход"),
    ("оборудование", r"оборудован|установк|флотомашин|ячейк"),
    ("режим флотации", r"флотац|время|скорост|аэрац"),
    ("состав руды", r"сульфид|мед|пород|минерал"),
    ("экономика", r"себестоим|бюджет|капитал|trl"),
)
CONFLICT_STOP = (
    "флотация", "флотации", "осуществляется", "загрузкой", "подавление", "подавления", "хвосты", "хвостов", "концентрат",
    "концентрата", "процесса", "процесс", "является", "использование", "применение", "методы", "методов", "условия",
)
INCREASE = ("increase", "повыша", "улучша", "рост", "увелич")
DECREASE = ("decrease", "снижа", "ухудша", "паден", "уменьш")

# Marks of KPI chunks.
KPI_CHUNK = ("# kpi-сводка", "тег: enterprise_kpi", "итого извлекаемый металл в хвостах", "отвальные хвосты:")

# Table rules (pattern, rule), tried in this order, and header rules (field, parts of the header).
TABLE_RULES = (
    (r"yield|выход|recovery|извлечени\w*", "yield"),
    (r"strength|прочност|tensile|hardness", "strength"),
    (r"efficien\w*|эффективн", "efficiency"),
    (r"cost|себестоим|opex|capex", "cost"),
    (r"quality|качеств|grade|purity", "quality"),
    (r"viscosity|вязкост", "viscosity"),
    (r"conductiv|проводим", "conductivity"),
    (r"density|плотност", "density"),
    (r"temperature|температур", "temperature"),
    (r"отвальн\w*\s+хвост", "tailings"),
    (r"итого\s+извлекаем\w*\s+металл", "recoverable"),
    (r"класс\s+крупност", "grain_header"),
)
HEADER_RULES = (
    ("sample_id", ("sample_id", "sample", "проба", "образец", "id пробы")),
    ("pH", ("ph",)),
    ("reagent_dosage", ("reagent_dosage", "dosage", "доз", "реагент", "kg_t", "кг/т", "кг_т")),
    ("temperature_C", ("temperature", "temp", "темп")),
    ("recovery_pct", ("recovery", "recover", "извлеч", "выход", "содерж")),
)

# Default weights and limits.
RANKING_WEIGHTS = {"novelty": 0.3, "feasibility": 0.25, "expected_value": 0.3, "risk": 0.15}
OBJECTIVE = {"approval": 0.55, "score": 0.45}
RUN_INDEX = {"approval": 0.50, "score": 0.35, "grounding": 0.15}
APPROVE_SCORE, ISSUE_PENALTY, OVERLAP_MIN = 6.5, 0.55, 0.30

# Terms of the domain that a hypothesis may name, looked for as patterns in it and as written in excerpts;
# words that are no terms or keywords; what ends a sentence before and behind an excerpt.
DOMAIN_TERMS = (
    r"кмц|карбоксиметилцеллюлоз", r"сернист\w+ натр", r"сернокисл\w+ желез", r"цианид", r"извест", r"собирател", r"пирит", r"флотац",
    r"магнитн", r"мельниц", r"гидроциклон", r"грохот", r"измельч", r"сепарац", r"\d+[\.,]?\d*\s*кг\s*/\s*т", r"pH\s*\d",
)
TERM_STOP = ("повышение", "извлечение", "оптимизация", "гипотеза", "процесс", "улучшит")
KEYWORD_STOP = ("которые", "является", "согласно", "данным", "источник")
SENTENCE_STARTS = (". ", ".\n", "; ", ":\n", "\n\n")
SENTENCE_ENDS = (". ", ".\n", "; ", "\n\n")

# Constraints and the wording that breaks them.
NO_CAPEX = ("без капитальных", "без капвложений")
CAPEX = r"(?<!без\s)капитальн.{0,12}вложен|(?<!без\s)новое оборудован|строительств|магнитн.{0,12}флотац|новая установк"
TRL_4 = ("trl 4", "trl4")
ABOVE_TRL_4 = r"промышленн.{0,8}внедрен|пилотн.{0,12}цех|на\s+заводе|заводск.{0,8}масштаб|цехов.{0,8}испытан"

# Words that are no keywords of a structured document; kinds of entities; hints that constraints call for.
STRUCTURE_STOP = ("изменение", "замена", "полная", "после", "провести", "опробование")
ENTITY_SCHEMA = "entities array<struct<name:string,type:string,properties:map<string,string>>>"
RULE_HINTS = (
    (("без капитальн",), "Только лабораторные/пилотные испытания на существующем оборудовании, TRL 4"),
    (("ph 8",), "pH гипотезы строго в диапазоне 8–10"),
    (("концентрат", "сульфид"), "Учебник: схемы селективности; указывай ≥3% как критерий успеха при отсутствии точного %"),
)
