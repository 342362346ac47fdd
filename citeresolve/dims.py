"""Closed dimensions of the domain: fixed values that results depend on."""

from __future__ import annotations

COURTS = ("STF", "STJ", "TSE", "TST", "STM")
UFS = "AC AL AP AM BA CE DF ES GO MA MT MS MG PA PB PR PE PI RJ RN RS RO RR SC SP SE TO".split()
#: Letters a page reader takes for digits, and the digits.
OCR_LETTERS, OCR_DIGITS = "OoQDlIi|SsLgqGbBZz", "000011115519966822"
#: Accented Latin letters and their plain forms.
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñýÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝºª"
PLAIN = "aaaaaeeeeiiiiooooouuuucnyAAAAAEEEEIIIIOOOOOUUUUCNYoa"
INVISIBLE = "​‌‍‎‏⁠﻿\xad"
ODD_SPACES = "\xa0     "
#: Statutes: key, year in force, names.
DIPLOMAS = {
    "CF": (1988, ["constituicao federal", "constituicao da republica", "cf", "crfb", "cr"]),
    "CLT": (1943, ["consolidacao das leis do trabalho", "clt"]),
    "CPC": (2015, ["codigo de processo civil", "cpc", "ncpc"]),
    "CPP": (1941, ["codigo de processo penal", "cpp"]),
    "CPM": (1969, ["codigo penal militar", "cpm"]),
    "CP": (1940, ["codigo penal", "cp"]),
    "CC": (2002, ["codigo civil", "cc"]),
    "CDC": (1990, ["codigo de defesa do consumidor", "cdc"]),
    "CE": (1965, ["codigo eleitoral"]),
    "LC64/1990": (1990, ["lei complementar 64/1990", "lc 64/1990"]),
}
#: Laws by number.
LAW_NUMBERS = {
    "5452/1943": "CLT",
    "13105/2015": "CPC",
    "3689/1941": "CPP",
    "1001/1969": "CPM",
    "2848/1940": "CP",
    "10406/2002": "CC",
    "8078/1990": "CDC",
    "4737/1965": "CE",
    "64/1990": "LC64/1990",
}
#: Classes in order of preference: code, name folded, courts that have it.
CLASSES = (
    ("AREsp", "agravo em recurso especial", ("STJ",)),
    ("REspe", "recurso especial eleitoral", ("TSE",)),
    ("AIRR", "agravo de instrumento em recurso de revista", ("TST",)),
    ("ARR", "recurso de revista com agravo", ("TST",)),
    ("ARE", "recurso extraordinario com agravo", ("STF",)),
    ("RHC", "recurso em habeas corpus", ("STJ", "STF")),
    ("RMS", "recurso em mandado de seguranca", ("STJ", "STF")),
    ("RSE", "recurso em sentido estrito", ("STM",)),
    ("SLS", "suspensao de liminar", ("STJ",)),
    ("REsp", "recurso especial", ("STJ",)),
    ("RE", "recurso extraordinario", ("STF",)),
    ("RR", "recurso de revista", ("TST",)),
    ("RO", "recurso ordinario", ("TSE", "STF", "STJ")),
    ("AR", "acao rescisoria", ("STJ", "STF", "TSE", "STM")),
    ("AI", "agravo de instrumento", ("TSE", "STF")),
    ("APL", "apelacao", ("STM",)),
    ("HC", "habeas corpus", ("STJ", "STF", "STM", "TSE")),
    ("Rcl", "reclamacao", ("STF", "STJ", "TSE", "STM")),
)
#: Court of a descriptive mention that names only the class.
CLASS_COURT = {
    "REsp": "STJ", "AREsp": "STJ", "RHC": "STJ", "RMS": "STJ", "SLS": "STJ", "RE": "STF", "ARE": "STF",
    "REspe": "TSE", "APL": "STM", "RSE": "STM", "RR": "TST", "AIRR": "TST", "ARR": "TST",
}
#: Appeal markers: code, pattern over folded words set apart by two spaces, pattern over the folded text itself. The short forms "Ag" and "E"
#: before a hyphen count as an internal appeal and as embargos de divergência, as in the records.
MARKERS = (
    ("AGINT", " (?:agint|ag  int|agravo  interno) ", "(?:^|[^a-z])ag-"),
    ("AGRG", " (?:agrg|agr|ag  reg|agravo  regimental) ", None),
    ("ED", " (?:edcl|eds?|embargos  (?:de  )?declaracao) ", None),
    ("EDV", " (?:edv|embargos  (?:de  )?divergencia|recurso  de  embargos) ", "(?:^|[ -])e-[a-z]"),
    ("PEXT", " pext ", None),
)
#: Abbreviations of class and appeal names, with a full stop: what is written, what it stands for.
ABBREVIATIONS = {
    "rec.": "recurso", "ag.": "agravo", "agr.": "agravo", "esp.": "especial", "espec.": "especial", "extr.": "extraordinario", "extraord.": "extraordinario", "ord.": "ordinario",
    "inst.": "instrumento", "rev.": "revista", "hab.": "habeas", "corp.": "corpus", "mand.": "mandado", "seg.": "seguranca", "susp.": "suspensao", "lim.": "liminar",
    "apel.": "apelacao", "recl.": "reclamacao", "resc.": "rescisoria", "emb.": "embargos", "embs.": "embargos", "decl.": "declaracao", "div.": "divergencia", "diverg.": "divergencia",
    "int.": "interno", "reg.": "regimental", "eleit.": "eleitoral",
}
STOPWORDS = (
    "a o as os de da do das dos e em no na nos nas por para com que se nao ao aos um uma "
    "ou como mais pelo pela pelos pelas sua seu suas seus art lei nº n recurso"
).split()
NAME_STOP = "min ministro ministra de da do dos das e rel relator relatora".split()
#: Vocabulary for repairing and expanding legal words, in order of preference.
LEGAL_WORDS = (
    "recurso agravo especial embargos declaracao regimental interno habeas corpus reclamacao apelacao criminal "
    "mandado seguranca instrumento ordinario extraordinario sentido estrito rescisoria acao eleitoral divergencia "
    "revista suspensao liminar sentenca constituicao constitucional federal republica codigo processo processual "
    "civil penal militar consumidor defesa consolidacao leis trabalho complementar sumula vinculante enunciado "
    "artigo inciso paragrafo alinea precedentes relatoria relator relatora julgado julgamento ministro ministra"
).split()
#: Confidence of each resolution rule.
CONFIDENCE = {
    "real_exato": 0.98, "real_ocr": 0.96, "real_cadeia_divergente": 0.93, "real_duplicata": 0.85,
    "real_atributo_divergente": 0.60, "real_descritiva": 0.80, "inventada": 0.97, "inventada_ocr": 0.95,
    "incompleta_descritiva": 0.97, "incompleta_descritiva_sem_registro": 0.60, "incompleta_sem_numero": 0.55,
    "erro_interno": 0.40,
}
REVIEW_CONFIDENCE = {"real_nlp": 0.92, "inventada_nlp": 0.92, "incompleta_nlp": 0.85, "novo": 0.92}
