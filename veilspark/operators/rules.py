"""Detection rules: what a pattern means (labels), where it holds (countries, languages), how sure a bare match is, which
check it must pass, and which words nearby make it surer.

Patterns are built from shapes of digit groups where they are no more than that. Scores, patterns, check names and
context words are fixed values of the rules."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from veilspark.functions.validators import VALIDATORS
from veilspark.labels import Catalog

BASELINE = 0.35


@dataclass(frozen=True)
class Variant:
    """needs: a pattern that is found in every text with a match, a cheap test before the search; None if there is none."""

    regex: str
    score: float = 1.0
    validator: str | None = None
    needs: str | None = None


@dataclass(frozen=True)
class Context:
    """Words that lift a label. language None: in any text; lemmas: the words are lemmas of tokens, where a text has any."""

    keywords: tuple[str, ...]
    language: str | None = None
    boost: float = 0.35
    before: int = 5
    after: int = 5
    word_boundary: bool = True
    lemmas: bool = False


@dataclass(frozen=True)
class Rule:
    name: str
    labels: tuple[str, ...]
    variants: tuple[Variant, ...]
    countries: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    context: tuple[Context, ...] = ()
    dictionaries: tuple[str, ...] = ()


@dataclass(frozen=True)
class Scope:
    """What is known about a call: asserted languages, countries, and the labels of interest."""

    languages: tuple[str, ...] = ()
    countries: tuple[str, ...] = ()
    catalog: Catalog = field(default_factory=Catalog)


def digits(*sizes: int, sep: str = "", first: str = "") -> str:
    """A bounded run of digit groups; `first` takes the first digit's place."""
    out = []
    for i, n in enumerate(sizes):
        n -= bool(first and not i)
        out.append((first if first and not i else "") + (rf"\d{{{n}}}" if n > 1 else r"\d" * n))
    return r"\b" + sep.join(out) + r"\b"


def _rule(name: str, label: str, variants: list[tuple], where: str = "", context: str | dict[str, str] = "", dictionaries: str = "", needs: str | None | tuple[str | None, ...] = r"\d") -> Rule:
    """where: "DE de", "CA en,fr" or "US -"; context: words, or words by language; needs: of all variants, or of each."""
    countries, _, languages = where.partition(" ")
    words = lambda s: tuple(w.strip() for w in s.split(";") if w.strip())
    ctx = tuple(Context(words(v), k) for k, v in context.items()) if isinstance(context, dict) else ((Context(words(context)),) if context else ())
    needs = needs if isinstance(needs, tuple) else (needs,) * len(variants)
    return Rule(name, (label,), tuple(Variant(v[1], v[0], v[2] if len(v) > 2 else None, n) for v, n in zip(variants, needs, strict=True)), (countries,) if countries else (), tuple(x for x in languages.split(",") if x and x != "-"), ctx, words(dictionaries))


S, H = r"\s", "-"
DAY, MONTH = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])"

AUSTRALIA = [
    _rule("au-abn", "company_id", [(0.4, digits(2, 3, 3, 3, sep=S), "au.abn"), (0.2, digits(11), "au.abn")], "AU en", "australian business number; abn; abr; australian business register"),
    _rule("au-acn", "company_id", [(0.4, digits(3, 3, 3, sep=S), "au.acn"), (0.1, digits(9), "au.acn")], "AU en", "australian company number; acn; asic; australian securities and investments commission"),
    _rule("au-medicare", "insurance_id", [(0.4, digits(4, 5, 1, sep=S, first="[2-6]"), "au.medicare"), (0.2, digits(10, first="[2-6]"), "au.medicare")], "AU en", "medicare; medicare card; medicare number; services australia"),
    _rule("au-tfn", "tax_id", [(0.4, digits(3, 3, 3, sep=S), "au.tfn"), (0.1, digits(9), "au.tfn")], "AU en", "tax file number; tfn; australian taxation office; ato"),
]

CANADA = [
    _rule("ca-postal-code", "postal_code", [(0.5, r"\b[ABCEGHJ-NPRSTVXY]\d[A-CEGHJ-NPRSTV-Z][ -]?\d[A-CEGHJ-NPRSTV-Z]\d\b")], "CA en,fr", "postal code; code postal; canada post; postes canada; mailing address; adresse postale"),
    _rule("ca-sin", "government_id", [(0.5, digits(3, 3, 3, sep=" ", first="[1-79]"), "ca.sin"), (0.5, digits(3, 3, 3, sep=H, first="[1-79]"), "ca.sin"), (0.2, digits(9, first="[1-79]"), "ca.sin")], "CA en,fr", "sin; social insurance number; social insurance; nas; numéro d'assurance sociale; numéro nas; assurance sociale"),
]

_DE_SERIAL = r"\b[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{7}\d\b"
GERMANY = [
    _rule("de-plz", "postal_code", [(0.2, r"\b(?:0[1-9]|[1-9]\d)\d{3}\b", "de.plz")], "DE de", "postleitzahl; plz; postanschrift; anschrift; lieferadresse; rechnungsadresse; postfach"),
    _rule("de-handelsregister", "company_id", [(0.5, r"\bHR[AB]\s*\d{1,6}\b")], "DE de", "handelsregister; handelsregisternummer; registernummer; registergericht; amtsgericht; hrb; hra; handelsregister-nr; hr-nummer", needs="HR[AB]"),
    _rule("de-bsnr", "medical_id", [(0.2, digits(9), "de.bsnr")], "DE de", "betriebsstättennummer; betriebsstätten-nummer; bsnr; betriebsstätte; praxisnummer; arztpraxis; praxis; kassenärztliche vereinigung; kv-nummer; kv nummer; praxisadresse; praxisstandort; behandlungsort; vertragsarztpraxis"),
    _rule("de-health-insurance", "insurance_id", [(0.3, r"\b[A-Z]\d{9}\b", "de.health_insurance")], "DE de", "krankenversicherungsnummer; krankenversichertennummer; versichertennummer; kvnr; krankenkasse; krankenversicherung; gesundheitskarte; egk; elektronische gesundheitskarte; gkv; gesetzliche krankenversicherung; krankenversicherungsausweis; versichertenausweis; versichertenkarte; aok; tkk; barmer; dak"),
    _rule("de-lanr", "medical_id", [(0.3, digits(9), "de.lanr")], "DE de", "arztnummer; lanr; lebenslange arztnummer; arzt-nr; arzt nr; arzt-nummer; vertragsarzt; kassenarzt; niedergelassener arzt; kbv; rezept; verschreibung; behandelnder arzt; hausarzt; facharzt"),
    _rule("de-fuehrerschein", "drivers_license", [(0.35, r"\b[A-Z]\d{2}[A-Z0-9]{6}\d[A-Z0-9]\b")], "DE de", "führerscheinnummer; führerschein; fahrerlaubnis; fahrerlaubnisnummer; fahrerlaubnisklasse; führerscheininhaber; fev; kba; kraftfahrt-bundesamt; driving licence; driving license; driver's license; licence number; license number; dokument nr; dokument-nr; feld 5"),
    _rule("de-id-card", "government_id", [(0.4, _DE_SERIAL, "de.id_card"), (0.5, r"\bT\d{8}\b", "de.id_card")], "DE de", "personalausweis; ausweis; personalausweisnummer; ausweisnummer; ausweisdokument; dokumentennummer; seriennummer; npa; neuer personalausweis; personalausweisgesetz; bundespersonalausweis; identity card; national id"),
    _rule("de-passport", "passport_number", [(0.4, _DE_SERIAL, "de.passport")], "DE de", "passnummer; reisepassnummer; passport number; pass-nr; dokumentennummer; reisepass; reisedokument; bundesdruckerei"),
    _rule("de-social-security", "national_insurance_number", [(0.5, r"\b\d{8}[A-Z]\d{3}\b", "de.social_security")], "DE de", "rentenversicherungsnummer; sozialversicherungsnummer; versicherungsnummer; rvnr; svnr; sv-nummer; rentenversicherung; deutsche rentenversicherung; drv; sozialversicherung"),
    _rule("de-tax-id", "tax_id", [(0.4, digits(11, first="[1-9]"), "de.tax_id")], "DE de", "steueridentifikationsnummer; steuerliche identifikationsnummer; persönliche identifikationsnummer; idnr; steuer-idnr; steuer idnr; steueridentnummer; bzst; bundeszentralamt für steuern"),
    _rule("de-tax-number", "tax_id", [(0.2, digits(13)), (0.4, digits(3, 4, 4, sep="/")), (0.3, r"\b\d{2,3}/\d{3}/\d{4,5}\b")], "DE de", "steuernummer; st-nr; stnr; st.-nr; steuer-nr; finanzamt; bundeseinheitliche steuernummer; vereinheitlichtes bundesschema"),
    _rule("de-vat-id", "tax_id", [(0.5, r"\bDE\d{9}\b", "de.vat_id"), (0.4, r"\bDE(?:[\s.\-]?\d{3}){3}\b", "de.vat_id")], "DE de", "umsatzsteuer-identifikationsnummer; umsatzsteueridentifikationsnummer; ust-idnr; ustidnr; ust idnr; ust-id; umsatzsteuer; mehrwertsteuer; mwst-id; vat number; vat id"),
    _rule("de-kfz", "license_plate", [(0.3, r"\b[A-ZÄÖÜ]{1,3}[-\s][A-Z]{1,2}\s?\d{1,4}H?E?\b"), (0.2, r"\b[A-Z]{1,3}[-\s][A-Z]{1,2}\s?\d{1,4}H?E?\b"), (0.2, r"\b[A-ZÄÖÜ]{1,3}[A-Z]{1,2}\d{1,4}H?E?\b"), (0.1, r"\b0\s?\d{1,4}\b"), (0.3, r"\b[A-ZÄÖÜ]{1,3}[-\s][A-Z]{1,2}\s?\d{1,4}\s\d{2}\b")], "DE de", "kennzeichen; kfz-kennzeichen; kfz kennzeichen; amtliches kennzeichen; fahrzeugschein; fahrzeugbrief; zulassung; nummernschild"),
]

SPAIN = [
    _rule("es-codigo-postal", "postal_code", [(0.2, r"\b(?:0[1-9]|[1-4]\d|5[0-2])\d{3}\b")], "ES es", "código postal; codigo postal; cp; c.p.; dirección postal"),
    _rule("es-cif", "company_id", [(0.5, r"\b[ABCDEFGHJNPQRSUVW]-?\d{7}-?[0-9A-J]\b", "es.cif")], "ES es", "código de identificación fiscal; cif; identificación fiscal; sociedad; empresa"),
    _rule("es-nie", "government_id", [(0.5, r"\b[XYZ]-?\d{7}-?[A-Z]\b", "es.nie")], "ES es", "número de identidad de extranjero; número de identificación de extranjero; nie; tarjeta de residencia; residencia; extranjero"),
    _rule("es-nif", "government_id", [(0.5, r"\b\d{7,8}-?[A-Z]\b", "es.nif")], "ES es", "documento nacional de identidad; número de identificación fiscal; dni; nif; identificación; identidad"),
    _rule("es-passport", "passport_number", [(0.1, r"\b[A-Z]{3}\d{6}\b")], "ES es", "pasaporte; número de pasaporte; passport; passport number"),
]

INDIA = [
    _rule("in-gstin", "tax_id", [(0.6, r"\b(?:0[1-9]|[12]\d|3[0-7])[A-Z]{5}\d{4}[A-Z][A-Z0-9]Z[A-Z0-9]\b", "in.gstin")], "IN en,hi", "gstin; gst; goods and services tax; gst number; gst registration"),
    _rule("in-aadhaar", "government_id", [(0.4, digits(4, 4, 4, sep=S, first="[2-9]"), "in.aadhaar"), (0.4, digits(4, 4, 4, sep=H, first="[2-9]"), "in.aadhaar"), (0.2, digits(12, first="[2-9]"), "in.aadhaar")], "IN en,hi", "aadhaar; uidai; unique identification authority; आधार"),
    _rule("in-pan", "tax_id", [(0.5, r"\b[A-Z]{3}[ABCFGHJLPTabcfghjlpt][A-Z]\d{4}[A-Z]\b", "in.pan")], "IN en,hi", "pan; permanent account number; income tax; pan card"),
    _rule("in-passport", "passport_number", [(0.2, r"\b[A-Z][1-9]\d\s?\d{4}[1-9]\b")], "IN en,hi", "passport; indian passport; passport number; ministry of external affairs"),
    _rule("in-voter", "government_id", [(0.4, r"\b[A-Z][ABCDGHJKMNPRSY][A-Z]\d{7}\b"), (0.3, r"\b[A-Z]{3}\d{7}\b")], "IN en,hi", "voter; voter id; epic; elector photo identity card; election commission; मतदाता"),
    _rule("in-vehicle-registration", "license_plate", [(0.5, r"\b[A-Z]{2}\d{2}[A-Z]{1,2}\d{4}\b"), (0.4, r"\b[A-Z]{2}\d[A-Z]{1,3}\d{4}\b"), (0.4, r"\b\d{1,3}(?:CD|CC|UN)[1-9]\d{1,3}\b")], "IN en,hi", "rto; vehicle; registration plate; vehicle number; regional transport office"),
]

#: A code's digits may be written as letters: L for 0, M to V for 1 to 9 (without O).
_IT_NAME = "(?:[A-Z][AEIOU][AEIOUX]|[AEIOU]X{2}|[B-DF-HJ-NP-TV-Z]{2}[A-Z])"
_IT_DAYS = r"(?:[A-EHLMPR-T](?:[04LQ][1-9MNP-V]|[15MR][\dLMNP-V]|[26NS][0-8LMNP-U])|[DHPS][37PT][0L]|[ACELMRT][37PT][01LM]|[AC-EHLMPR-T][26NS][9V])"
_IT_LEAP = "(?:[02468LNQSU][048LQU]|[13579MPRTV][26NS])B[26NS][9V]"
_IT_PLACE = r"(?:[A-MZ][1-9MNP-V][\dLMNP-V]{2}|[A-M][0L](?:[1-9MNP-V][\dLMNP-V]|[0L][1-9MNP-V]))"
ITALY = [
    _rule("it-vat-code", "tax_id", [(0.3, digits(11), "it.vat_code")], "IT it", "partita iva; piva; p.iva; p. iva; numero iva; agenzia delle entrate"),
    _rule("it-driving-licence", "drivers_license", [(0.2, r"(?i)\b[A-Z]{2}\d{7}[A-Z]\b"), (0.3, r"(?i)\bU1[A-HJ-NP-Z0-9]{7}[A-Z]\b")], "IT it", "patente di guida; patente; motorizzazione civile; numero patente"),
    _rule("it-fiscal-code", "tax_id", [(0.4, rf"(?i)\b{_IT_NAME}{{2}}(?:[\dLMNP-V]{{2}}{_IT_DAYS}|{_IT_LEAP}){_IT_PLACE}[A-Z]\b", "it.fiscal_code")], "IT it", "codice fiscale; cf; c.f.; tessera sanitaria; agenzia delle entrate", needs=None),
    _rule("it-identity-card", "government_id", [(0.05, r"(?i)\b[A-Z]{2}\s?\d{7}\b"), (0.05, r"(?i)\b\d{7}[A-Z]{2}\b"), (0.05, r"(?i)\b[A-Z]{2}\d{5}[A-Z]{2}\b")], "IT it", "carta d'identità; carta di identità; carta identità; cie; documento di identità; documento di riconoscimento; espatrio"),
    _rule("it-passport", "passport_number", [(0.05, r"(?i)\b[A-Z]{2}\d{7}\b")], "IT it", "passaporto; passaporto italiano; passaporto elettronico; documento di viaggio; polizia di stato; dogana"),
]

KOREA = [
    _rule("kr-brn", "company_id", [(0.5, digits(3, 2, 5, sep=H), "kr.brn"), (0.2, digits(10), "kr.brn")], "KR ko", "brn; 사업자등록번호; 사업자번호; 사업자; business registration number; korean brn; business number; tax registration number"),
    _rule("kr-driver-license", "drivers_license", [(0.4, digits(2, 2, 6, 2, sep=H), "kr.driver_license"), (0.2, digits(12), "kr.driver_license")], "KR ko", "운전면허; 운전면허번호; 면허번호; korean driver license; korean driver's license; driver license number"),
    _rule("kr-frn", "government_id", [(0.5, rf"\b\d{{2}}{MONTH}{DAY}-[5-8]\d{{6}}\b", "kr.frn"), (0.4, rf"\b\d{{2}}{MONTH}{DAY}[5-8]\d{{6}}\b", "kr.frn")], "KR ko", "frn; 외국인등록번호; 외국인번호; foreigner registration number; korean frn"),
    _rule("kr-passport", "passport_number", [(0.2, r"\b[MSRODmsrod]\d{3}[A-Za-z]\d{4}\b"), (0.1, r"\b[MSRODmsrod]\d{8}\b")], "KR ko", "passport; passport number; korean passport; 여권; 대한민국 여권; 여권번호"),
    _rule("kr-rrn", "government_id", [(0.5, rf"\b\d{{2}}{MONTH}{DAY}-[1-4]\d{{6}}\b", "kr.rrn"), (0.4, rf"\b\d{{2}}{MONTH}{DAY}[1-4]\d{{6}}\b", "kr.rrn")], "KR ko", "rrn; 주민등록번호; 주민번호; korean rrn; korean resident registration number; resident registration number"),
]

POLAND = [
    _rule("pl-kod-pocztowy", "postal_code", [(0.4, digits(2, 3, sep=H))], "PL pl", "kod pocztowy; kod; poczta polska; adres pocztowy"),
    _rule("pl-nip", "tax_id", [(0.3, digits(10), "pl.nip"), (0.5, digits(3, 3, 2, 2, sep=H), "pl.nip"), (0.4, digits(3, 2, 2, 3, sep=H), "pl.nip")], "PL pl", "nip; numer identyfikacji podatkowej; identyfikacja podatkowa; urząd skarbowy; ministerstwo finansów"),
    _rule("pl-regon", "company_id", [(0.3, digits(9), "pl.regon"), (0.4, digits(14), "pl.regon")], "PL pl", "regon; numer regon; rejestr gospodarki narodowej; gus; główny urząd statystyczny"),
    _rule("pl-pesel", "government_id", [(0.4, rf"\b\d{{2}}(?:[02468][1-9]|[13579][012]){DAY}\d{{5}}\b", "pl.pesel")], "PL pl", "pesel; numer pesel; numer ewidencyjny; ewidencja ludności"),
]

NORDIC = [
    _rule("fi-hetu", "government_id", [(0.5, r"\b\d{6}[+\-A-FYXWVU]\d{3}[0-9A-FHJKLMNPRSTUVWXY]\b", "fi.hetu")], "FI fi,sv", "henkilötunnus; hetu; personbeteckning; personbeteckningen; personal identity code; social security number; dvv"),
    _rule("se-postnummer", "postal_code", [(0.2, digits(3, 2, sep=S, first="[1-9]")), (0.2, digits(5, first="[1-9]"))], "SE sv", "postnummer; post; postnord; postadress; postal code"),
    _rule("se-organisationsnummer", "company_id", [(0.6, r"\b\d{6}-?\d{4}\b", "se.organisationsnummer")], "SE sv", "organisationsnummer; orgnr; org nr; org.nr; företagsnummer; bolagsverket"),
    _rule("se-personnummer", "government_id", [(0.5, r"\b\d{8}[+\-]?\d{4}\b", "se.personnummer"), (0.5, r"\b\d{6}[+\-]?\d{4}\b", "se.personnummer")], "SE sv", "personnummer; svenskt personnummer; personlig identitet; samordningsnummer; ssn; personal identity number"),
]

OTHER_COUNTRIES = [
    _rule("ng-nin", "government_id", [(0.3, digits(11), "ng.nin")], "NG en", "nin; national identification number; national identity number; nimc; national identity; nigeria id; nigerian identification"),
    _rule("ng-vehicle-registration", "license_plate", [(0.5, r"\b[A-Z]{3}[- ]?\d{3}[A-Z]{2}\b")], "NG en", "plate number; vehicle registration; license plate; number plate; frsc; federal road safety corps"),
    _rule("sg-postal-code", "postal_code", [(0.2, r"\b(?:0[1-9]|[1-7]\d|8[0-2])\d{4}\b")], "SG en", "postal code; singapore post; singpost; mailing address"),
    _rule("sg-uen", "company_id", [(0.3, r"\b\d{8}[A-Z]\b", "sg.uen"), (0.3, r"\b\d{9}[A-Z]\b", "sg.uen"), (0.5, r"\b[TSR]\d{2}[A-Z]{2}\d{4}[A-Z]\b", "sg.uen")], "SG en", "uen; unique entity number; acra; business registration; company registration"),
    _rule("sg-nric", "government_id", [(0.5, r"\b[STFGM]\d{7}[A-Z]\b", "sg.nric"), (0.2, r"\b[A-Z]\d{7}[A-Z]\b", "sg.nric")], "SG en", "nric; nric#; fin; fin#; national registration; national registration identity; ica"),
    _rule("th-postal-code", "postal_code", [(0.2, r"\b(?:1\d|[2-8]\d|9[0-6])\d{3}\b")], "TH th", "รหัสไปรษณีย์; ไปรษณีย์; ที่อยู่; postal code; thailand post"),
    _rule("th-national-id", "government_id", [(0.5, digits(1, 4, 5, 2, 1, sep=H, first="[1-8]"), "th.national_id"), (0.3, digits(13, first="[1-8]"), "th.national_id")], "TH th", "เลขประจำตัวประชาชน; เลขบัตรประชาชน; บัตรประจำตัวประชาชน; national id; thai national id; thai id; id card"),
    _rule("tr-posta-kodu", "postal_code", [(0.2, r"\b(?:0[1-9]|[1-7]\d|8[01])\d{3}\b")], "TR tr", "posta kodu; ptt; adres; postal code"),
    _rule("tr-tckn", "government_id", [(0.4, digits(11, first="[1-9]"), "tr.tckn")], "TR tr", "tc kimlik; kimlik no; kimlik numarası; tckn; tc no; nüfus cüzdanı; national id; türk kimlik; turkish id"),
    _rule("tr-license-plate", "license_plate", [(0.4, r"\b(?:0[1-9]|[1-7]\d|8[01])\s?[A-PR-VY-Z]{1,3}\s?\d{2,4}\b"), (0.5, r"\b(?:0[1-9]|[1-7]\d|8[01])-[A-PR-VY-Z]{1,3}-\d{2,4}\b")], "TR tr", "plaka; araç plakası; plaka numarası; kayıt plakası; taşıt plakası; tr plaka; license plate; number plate"),
]

_UK_IN = r"\s?\d[ABD-HJLNP-UW-Z]{2}"
UNITED_KINGDOM = [
    _rule("uk-postcode", "postal_code", [(0.1, rf"\b(?:GIR\s?0AA|(?:[A-PR-UWYZ]\d[ABCDEFGHJKPSTUW]?|[A-PR-UWYZ]\d{{2}}|[A-PR-UWYZ][A-HK-Y]\d[ABEHMNPRVWXY]?|[A-PR-UWYZ][A-HK-Y]\d{{2}}){_UK_IN})\b")], "GB en", "postcode; post code; postal code; zip; address; delivery; mailing; shipping; correspondence"),
    _rule("uk-driving-licence", "drivers_license", [(0.5, rf"\b[A-Z9]{{5}}\d(?:0[1-9]|1[0-2]|5[1-9]|6[0-2]){DAY}\d[A-Z9]{{2}}[A-Z0-9][A-Z]{{2}}\b", "uk.driving_licence")], "GB en", "driving licence; driving license; driver's licence; driver's license; dvla; dl number; licence number; license number"),
    _rule("uk-nhs", "medical_id", [(0.5, digits(3, 3, 4, sep="[- ]?"), "uk.nhs")], "GB en", "nhs; national health service; health services authority; health authority"),
    _rule("uk-nino", "national_insurance_number", [(0.5, r"(?i:\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z])(?: ?\d{2}){3} ?[A-Da-d]\b", "uk.nino")], "GB en", "national insurance; ni number; nino"),
    _rule("uk-passport", "passport_number", [(0.1, r"\b[A-Z]{2}\d{7}\b")], "GB en", "passport; passport number; travel document; uk passport; british passport; her majesty; his majesty; hm passport; hmpo"),
    _rule("uk-vehicle-registration", "license_plate", [(0.3, r"\b[A-HJ-PR-Y]{2}(?:0[1-9]|[1-7]\d)[- ]?[A-HJ-PR-Z]{3}\b", "uk.vehicle_registration"), (0.2, r"\b[A-HJ-NPR-TV-Y]\d{1,3}[- ]?[A-HJ-PR-Y][A-HJ-PR-Z]{2}\b"), (0.15, r"\b[A-HJ-PR-Z]{3}[- ]?\d{1,3}[- ]?[A-HJ-NPR-TV-Y]\b")], "GB en", "vehicle; registration; number plate; licence plate; license plate; reg; vrn; dvla; v5c; logbook; mot; car; insured vehicle"),
]

_MBI = "[ACDEFGHJKMNPQRTUVWXY]", "[0-9ACDEFGHJKMNPQRTUVWXY]"
_ITIN = r"(?:5\d|6[0-5]|7\d|8[0-8]|9[0-24-9])"
#: Shapes of the states' licences, letters and digits in order.
_US_LICENCES = r"[A-Z]\d{3}-\d{4}-\d{4}|[A-Z]\d{1,14}|[A-Z]\d{18}|[A-Z]{2}\d{2,7}|\d{2}[A-Z]{3}\d{5,6}|[A-Z]\d{6}R|\d{9}[A-Z]|[A-Z]{2}\d{6}[A-Z]|\d{8}[A-Z]{2}|\d{3}[A-Z]{2}\d{4}|[A-Z]\d[A-Z]\d[A-Z]|\d{7,8}[A-Z]"
UNITED_STATES = [
    _rule("us-bank-account", "bank_account", [(0.05, r"\b\d{8,17}\b")], "US en", "check; checking account; account; account#; acct; bank; save; savings; debit"),
    _rule("us-bank-routing", "bank_routing", [(0.5, r"\b(?:0[1-9]|[12]\d|3[0-2])\d{7}\b", "us.aba_routing"), (0.4, digits(4, 4, 1, sep=H, first="[0123678]"), "us.aba_routing")], "US en", "routing; aba; rtn; transit; bank; deposit; wire; ach"),
    _rule("us-mbi", "medical_id", [(0.3, rf"\b\d{_MBI[0]}{_MBI[1]}\d{_MBI[0]}{_MBI[1]}\d{_MBI[0]}{{2}}\d{{2}}\b"), (0.5, rf"\b\d{_MBI[0]}{_MBI[1]}\d-{_MBI[0]}{_MBI[1]}\d-{_MBI[0]}{{2}}\d{{2}}\b")], "US en", "mbi; medicare beneficiary; medicare; beneficiary; cms"),
    _rule("us-medical-license", "medical_id", [(0.4, r"\b[A-HJ-MPR-UXa-hj-mpr-ux][a-zA-Z]\d{7}\b", "us.dea_number"), (0.4, r"\b[A-HJ-MPR-UXa-hj-mpr-ux]9\d{7}\b", "us.dea_number")], "US en", "medical; license; licence; certificate; dea; controlled substance; prescription; prescriber"),
    _rule("us-npi", "medical_id", [(0.1, digits(10, first="[12]"), "us.npi"), (0.4, digits(4, 3, 3, sep="[ -]", first="[12]"), "us.npi")], "US en", "npi; national provider; provider; npi number; provider id; provider identifier; taxonomy"),
    _rule("us-drivers-license", "drivers_license", [(0.25, rf"\b(?:{_US_LICENCES})\b")], "US en", "driver; drivers; driver's; license; licence; dl; dl#; dlnum"),
    _rule("us-itin", "tax_id", [(0.3, rf"\b9\d{{2}}[- ]{_ITIN}[- ]\d{{4}}\b"), (0.3, rf"\b9\d{{2}}{_ITIN}\d{{4}}\b")], "US en", "individual; taxpayer; itin; tax; payer; taxid; tin"),
    _rule("us-passport", "passport_number", [(0.1, r"\b[A-Z]\d{8}\b")], "US -", "passport; passport#; travel document; us passport; united states passport"),
    _rule("us-postal-code", "postal_code", [(0.2, r"\b\d{5}(?:-\d{4})?\b", "us.postal_code")], "US -", "zip; zip code; zipcode; postal; postal code; address; mailing"),
    _rule("ssn", "government_id", [(0.5, digits(3, 2, 4, sep="[- .]"), "us.ssn")], "US -", "social security; ssn; tax id; taxpayer identification"),
]

_MAIL = r"[!#$%&'*+\-/=?^_`{|}~\w]"
_HOST = r"\w+(?:[-.]\w+)*"
_SECRET_NAME = r"(?:api[_\-\s]?key|api[_\-\s]?secret|access[_\-\s]?token|secret[_\-\s]?key)"
_SECRET = r"""["']?([a-zA-Z0-9_\-\.]{20,})["']?"""
_KEY_KIND = r"(?:(?:RSA|EC|DSA|OPENSSH|ENCRYPTED|PGP) )?PRIVATE KEY(?: BLOCK)?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
_HEX = "[0-9A-Fa-f]"
WORLD = [
    _rule("email", "email_address", [(0.5, rf"\b(?:{_MAIL}[!#$%&'*+\-/=?^_`{{|}}~.\w]*)?{_MAIL}@{_HOST}\.{_HOST}\b")], needs="@"),
    _rule("phone", "phone_number", [(0.4, r"(?:\+\d{1,3}[\s.\-]?)?\(?\d{2,4}\)?[\s.\-]?\d{3,4}[\s.\-]?\d{4}\b", "phone")], context={"en": "phone; call; mobile; tel; fax; contact", "es": "teléfono; telefono; llamar; móvil; movil; celular; tel; fax; contacto", "de": "telefon; anruf; mobil; handy; tel; fax; kontakt", "fr": "téléphone; telephone; appel; mobile; portable; tel; fax; contact"}),
    _rule("url", "url", [(0.5, r"\bhttps?://[^\s/$.?#]\S*\b")], needs="https?://"),
    _rule("aws-key", "api_key", [(0.95, r"\b(?:AKIA|ASIA|AIDA|AROA|ANPA|AGPA|AIPA)[0-9A-Z]{16}\b"), (0.3, r"\b[A-Za-z0-9/+=]{40}\b")], context="aws; amazon; access key; secret access key; aws_access_key_id; aws_secret_access_key", needs=(None, None)),
    _rule("generic-api-key", "api_key", [(0.5, rf"(?i){_SECRET_NAME}\s*[:=]\s*{_SECRET}"), (0.5, rf"(?i)bearer\s+{_SECRET}"), (0.4, rf"(?i){_SECRET_NAME}\s+{_SECRET}")], needs=("(?i)key|secret|token", "(?i)bearer", "(?i)key|secret|token")),
    _rule("github-token", "auth_token", [(0.95, r"\bgh[pousr]_[a-zA-Z0-9]{36}\b"), (0.95, r"\bgithub_pat_[A-Z0-9_]{82}\b")], needs=("gh[pousr]_", "github_pat_")),
    _rule("private-key", "private_key", [(0.98, rf"-----BEGIN {_KEY_KIND}-----[\s\S]*?-----END {_KEY_KIND}-----"), (0.98, r"---- BEGIN SSH2 ENCRYPTED PRIVATE KEY ----[\s\S]*?---- END SSH2 ENCRYPTED PRIVATE KEY ----"), (0.98, r"PuTTY-User-Key-File-[23]:[\s\S]*?Private-MAC: [0-9a-f]+")], needs=("PRIVATE KEY", "PRIVATE KEY", "Private-MAC")),
    _rule("stripe-key", "api_key", [(0.95, r"\bsk_(?:live|test)_[a-zA-Z0-9]{24,}\b")], needs="sk_"),
    _rule("bitcoin-address", "crypto_address", [(0.5, r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b", "crypto.btc"), (0.5, r"\bbc1[a-z0-9]{25,59}\b")], needs=("[13]", "bc1")),
    _rule("credit-card", "payment_card", [(0.3, r"\b(?:5[0-5]\d{2}|2[2-7]\d{2}|[1346]\d{3})[- ]?\d{3,4}[- ]?\d{3,4}[- ]?\d{3,5}\b", "luhn")], context={"en": "card; credit; debit; payment; visa; mastercard; amex", "es": "tarjeta; crédito; credito; débito; debito; pago; visa; mastercard; amex", "de": "karte; kredit; kreditkarte; debit; zahlung; visa; mastercard; amex", "fr": "carte; crédit; credit; débit; debit; paiement; visa; mastercard; amex"}),
    _rule("ethereum-address", "crypto_address", [(0.5, rf"\b0x{_HEX}{{40}}\b")], needs="0x"),
    _rule("iban", "iban", [(0.5, r"\b[A-Z]{2}\d{2}[\s\-]?[A-Z0-9]{4}[\s\-]?(?:[A-Z0-9]{4}[\s\-]?){2,7}[A-Z0-9]{1,4}\b", "iban")], context="iban; bank; account; transfer; swift"),
    _rule("monetary-amount", "monetary_amount", [(0.3, r"\b\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?\b"), (0.2, r"\b\d+\.\d{2}\b"), (0.2, r"\b\d+,\d{2}\b"), (0.1, r"\b\d+\b")], dictionaries="currencies; cryptocurrencies"),
    _rule("swift-code", "swift_code", [(0.5, r"\b[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b")], needs=None),
    _rule("ipv4", "ip_address", [(0.6, rf"\b(?:{_OCTET}\.){{3}}{_OCTET}(?:/(?:[0-2]?\d|3[0-2]))?\b")]),
    _rule("ipv6", "ip_address", [(0.6, rf"\b(?:{_HEX}{{0,4}}:){{2,7}}[0-9A-Fa-f.]{{0,4}}(?:%[0-9A-Za-z]+)?(?:/\d{{1,3}})?", "ipv6"), (0.6, rf"::(?:{_HEX}{{1,4}}(?::{_HEX}{{1,4}})*(?:\.\d{{1,3}}){{0,3}})?(?:%[0-9A-Za-z]+)?(?:/\d{{1,3}})?", "ipv6")], needs=(rf":{_HEX}{{0,4}}:", "::")),
    _rule("mac-address", "mac_address", [(0.5, rf"\b(?:{_HEX}{{2}}[:\-]){{5}}{_HEX}{{2}}\b"), (0.5, rf"\b{_HEX}{{4}}(?:\.{_HEX}{{4}}){{2}}\b")], needs=None),
    _rule("date_of_birth", "date_of_birth", [(0.1, rf"\b(?:(?:0[1-9]|1[0-2]|[1-9])[/\-](?:0[1-9]|[12]\d|3[01]|[1-9])[/\-](?:19|20)\d{{2}}|(?:19|20)\d{{2}}[/\-]{MONTH}[/\-]{DAY})\b", "date")], context={"en": "birth; born; dob; birthday; date of birth", "es": "nacimiento; nacido; nacida; fecha de nacimiento; cumpleaños; cumpleanos", "de": "geburt; geboren; geburtsdatum; geburtstag", "fr": "naissance; né; nee; née; date de naissance; anniversaire"}),
    _rule("datetime", "date_time", [(0.1, rf"\b(?:19|20)\d{{2}}[/\-]{MONTH}[/\-]{DAY}[T ](?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d)?(?:Z|[+\-]\d{{2}}:?\d{{2}})?\b")], context={"en": "timestamp; created; modified; logged; at; time", "es": "marca de tiempo; creado; creada; modificado; modificada; registrado; a las; hora; fecha", "de": "zeitstempel; erstellt; geändert; geandert; protokolliert; um; uhrzeit; zeit", "fr": "horodatage; créé; cree; créée; creee; modifié; modifie; à; heure; date"}),
]

BUILT_IN: list[Rule] = [*AUSTRALIA, *CANADA, *GERMANY, *SPAIN, *INDIA, *ITALY, *KOREA, *POLAND, *NORDIC, *OTHER_COUNTRIES, *UNITED_KINGDOM, *UNITED_STATES, *WORLD]


def primary(tag: str) -> str:
    return tag.split("-")[0].lower()


def permits(languages: Iterable[str], asserted: Iterable[str], detected: Iterable[str] = ()) -> bool:
    """The permissive gate, for recognizers that take detected languages for true: an empty side passes, else any
    asserted or detected language has to be among the recognizer's."""
    own, known = {primary(x) for x in languages}, {primary(x) for x in (*asserted, *detected)}
    return not own or not known or bool(own & known)


def in_scope(rules: Iterable[Rule], scope: Scope) -> list[Rule]:
    """Rules whose country and language gates pass and whose label the catalog declares, settled before any scan.

    An empty side passes; only asserted languages gate, never detected ones."""
    out = []
    for r in rules:
        if r.countries and scope.countries and not {*r.countries} & {c.upper() for c in scope.countries}:
            continue
        if r.languages and scope.languages and not {primary(x) for x in r.languages} & {primary(x) for x in scope.languages}:
            continue
        label = scope.catalog.resolve(list(r.labels))
        if scope.catalog.declares(label):
            out.append(replace(r, labels=(label,)))
    return out


def compiled(rules: Iterable[Rule], most_chars: int = 1 << 20) -> list[tuple[Rule, Variant, re.Pattern]]:
    """Each variant's pattern; unknown checks and oversized patterns are errors."""
    out = []
    for r in rules:
        for v in r.variants:
            if v.validator and v.validator not in VALIDATORS:
                raise ValueError(f"rule {r.name}: no validator {v.validator!r}")
            if len(v.regex) > most_chars:
                raise ValueError(f"rule {r.name}: pattern of {len(v.regex)} characters")
            if not 0 <= v.score <= 1:
                raise ValueError(f"rule {r.name}: score {v.score}")
            out.append((r, v, re.compile(v.regex)))
    return out


def from_toml(text: str) -> Rule:
    """A rule as its users write it: name, labels, countries, languages, [[variants]] and [context]."""
    d = tomllib.loads(text)
    variants = tuple(Variant(v["regex"], float(v.get("score", 1.0)), v.get("validator")) for v in d.get("variants", ()))
    if not d.get("labels") or not variants:
        raise ValueError("a rule needs labels and variants")
    c = d.get("context") or {}
    if "keywords" in c or "dictionaries" in c:
        boost = float(c.get("boost", 0.35))
        context = (Context(tuple(c.get("keywords", ())), boost=boost, word_boundary=c.get("matching", "word") == "word"),) if c.get("keywords") else ()
    else:
        context = tuple(Context(tuple(v if isinstance(v, list) else v.get("keywords", ())), k) for k, v in c.items())
    return Rule(d["name"], tuple(d["labels"]), variants, tuple(d.get("countries", ())), tuple(d.get("languages", ())), context, tuple(c.get("dictionaries", ())) if isinstance(c, dict) else ())
