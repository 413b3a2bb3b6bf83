"""Dictionaries: terms that name a label by themselves, found by one automaton over all of them.

Matching is case-sensitive, leftmost-longest and without overlap across dictionaries; a match must stand between word
boundaries (letters, digits and underscore count as word characters). Terms are fixed values."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import ahocorasick


@dataclass(frozen=True)
class Dictionary:
    name: str
    label: str
    terms: tuple[tuple[str, float], ...]
    languages: tuple[str, ...] = ()
    word_boundary: bool = True


def from_text(name: str, label: str, text: str, score: float, languages: Iterable[str] = ()) -> Dictionary:
    """One term a line; # begins a comment."""
    lines = (x.partition("#")[0].strip() for x in text.splitlines())
    return Dictionary(name, label, tuple((x, score) for x in lines if x), tuple(languages))


def from_csv(name: str, label: str, text: str, scores: float | list[float], languages: Iterable[str] = ()) -> Dictionary:
    """Every cell is a term; one score for all, or one for each column (a column without one is an error)."""
    out = []
    for line in text.splitlines():
        for i, cell in enumerate(line.split(",")):
            if cell.strip():
                if isinstance(scores, list) and i >= len(scores):
                    raise ValueError(f"dictionary {name}: column {i} has no score")
                out.append((cell.strip(), scores[i] if isinstance(scores, list) else scores))
    return Dictionary(name, label, tuple(out), tuple(languages))


def _rows(name: str, label: str, rows: str, scores: float | list[float], languages: Iterable[str] = ()) -> Dictionary:
    return from_csv(name, label, rows.replace(";", "\n"), scores, languages)


# The terms. Rows are parted by semicolons, the columns of a row by commas.
CURRENCY_ROWS = (
    "US Dollar, USD; Euro, EUR; British Pound, GBP; Japanese Yen, JPY; Swiss Franc, CHF; Canadian Dollar, CAD; Australian Dollar, AUD; New Zealand Dollar, "
    "NZD; Chinese Yuan, CNY, Renminbi, RMB; Indian Rupee, INR; Brazilian Real, BRL; South Korean Won, KRW; Mexican Peso, MXN; Singapore Dollar, SGD; Hong "
    "Kong Dollar, HKD; Norwegian Krone, NOK; Swedish Krona, SEK; Danish Krone, DKK; South African Rand, ZAR; Russian Ruble, RUB; Turkish Lira, TRY; Israeli "
    "Shekel, ILS; Saudi Riyal, SAR; UAE Dirham, AED; Thai Baht, THB; Indonesian Rupiah, IDR; Malaysian Ringgit, MYR; Philippine Peso, PHP; Polish Zloty, "
    "PLN; Czech Koruna, CZK; Hungarian Forint, HUF; Romanian Leu, RON; Colombian Peso, COP; Chilean Peso, CLP; Peruvian Sol, PEN; Argentine Peso, ARS; "
    "Egyptian Pound, EGP; Nigerian Naira, NGN; Kenyan Shilling, KES; Ghanaian Cedi, GHS"
)
CRYPTOCURRENCY_ROWS = (
    "Bitcoin, BTC; Ethereum, ETH; Tether, USDT; USD Coin, USDC; Binance Coin, BNB; Ripple, XRP; Cardano, ADA; Solana, SOL; Dogecoin, DOGE; Polkadot, DOT; "
    "Avalanche, AVAX; Chainlink, LINK; Litecoin, LTC; Polygon, MATIC; Stellar, XLM; Monero, XMR; Uniswap, UNI; Cosmos, ATOM; Toncoin, TON"
)
RELIGION_ROWS = (
    "Buddhist; Catholic; Christian; Hindu; Jewish; Mormon; Muslim; Orthodox; Protestant; Sikh; Sunni; Shia; Evangelical; Anglican; Baptist; Methodist; "
    "Presbyterian; Lutheran; Pentecostal; Adventist; Jehovah's Witness; Quaker; Amish; Mennonite; Baha'i; Jain; Shinto; Taoist; Zoroastrian; Rastafari; "
    "Wiccan; Pagan; Atheist; Agnostic"
)
NATIONALITY_ROWS = (
    "Afghan; Albanian; Algerian; American; Andorran; Angolan; Argentine; Armenian; Australian; Austrian; Azerbaijani; Bahamian; Bahraini; Bangladeshi; "
    "Barbadian; Belarusian; Belgian; Belizean; Beninese; Bhutanese; Bolivian; Bosnian; Brazilian; British; Bruneian; Bulgarian; Burkinabe; Burmese; "
    "Burundian; Cambodian; Cameroonian; Canadian; Chilean; Chinese; Colombian; Congolese; Costa Rican; Croatian; Cuban; Cypriot; Czech; Danish; Dominican; "
    "Dutch; Ecuadorian; Egyptian; Emirati; Eritrean; Estonian; Ethiopian; Fijian; Filipino; Finnish; French; Gabonese; Georgian; German; Ghanaian; Greek; "
    "Guatemalan; Guinean; Guyanese; Haitian; Honduran; Hungarian; Icelandic; Indian; Indonesian; Iranian; Iraqi; Irish; Israeli; Italian; Ivorian; "
    "Jamaican; Japanese; Jordanian; Kazakh; Kenyan; Korean; Kuwaiti; Kyrgyz; Laotian; Latvian; Lebanese; Liberian; Libyan; Lithuanian; Luxembourgish; "
    "Macedonian; Malagasy; Malawian; Malaysian; Maldivian; Malian; Maltese; Mexican; Moldovan; Mongolian; Montenegrin; Moroccan; Mozambican; Namibian; "
    "Nepalese; New Zealander; Nicaraguan; Nigerian; Norwegian; Omani; Pakistani; Palestinian; Panamanian; Paraguayan; Peruvian; Polish; Portuguese; Qatari; "
    "Romanian; Russian; Rwandan; Saudi; Senegalese; Serbian; Singaporean; Slovak; Slovenian; Somali; South African; Spanish; Sri Lankan; Sudanese; Swedish; "
    "Swiss; Syrian; Taiwanese; Tajik; Tanzanian; Thai; Togolese; Trinidadian; Tunisian; Turkish; Turkmen; Ugandan; Ukrainian; Uruguayan; Uzbek; Venezuelan; "
    "Vietnamese; Yemeni; Zambian; Zimbabwean"
)
LANGUAGE_ROWS = (
    "Afrikaans, af; Albanian, sq; Amharic, am; Arabic, ar; Armenian, hy; Azerbaijani, az; Basque, eu; Belarusian, be; Bengali, bn; Bosnian, bs; Bulgarian, "
    "bg; Burmese, my; Cantonese, yue; Catalan, ca; Cebuano, ceb; Croatian, hr; Czech, cs; Danish, da; Dutch, nl; English, en; Esperanto, eo; Estonian, et; "
    "Filipino, fil; Finnish, fi; French, fr; Galician, gl; Georgian, ka; German, de; Greek, el; Gujarati, gu; Haitian Creole, ht; Hausa, ha; Hebrew, he; "
    "Hindi, hi; Hmong, hmn; Hungarian, hu; Icelandic, is; Igbo, ig; Indonesian, id; Irish, ga; Italian, it; Japanese, ja; Javanese, jv; Kannada, kn; "
    "Kazakh, kk; Khmer, km; Korean, ko; Kurdish, ku; Kyrgyz, ky; Lao, lo; Latin, la; Latvian, lv; Lithuanian, lt; Luxembourgish, lb; Macedonian, mk; "
    "Malagasy, mg; Malay, ms; Malayalam, ml; Maltese, mt; Mandarin, zh; Maori, mi; Marathi, mr; Mongolian, mn; Nepali, ne; Norwegian, no; Odia, or; Pashto, "
    "ps; Persian, fa, Farsi; Polish, pl; Portuguese, pt; Punjabi, pa; Quechua, qu; Romanian, ro; Russian, ru; Samoan, sm; Serbian, sr; Shona, sn; Sindhi, "
    "sd; Sinhala, si; Slovak, sk; Slovenian, sl; Somali, so; Spanish, es; Sundanese, su; Swahili, sw; Swedish, sv; Tagalog, tl; Tajik, tg; Tamil, ta; "
    "Tatar, tt; Telugu, te; Thai, th; Tibetan, bo; Turkish, tr; Turkmen, tk; Ukrainian, uk; Urdu, ur; Uzbek, uz; Vietnamese, vi; Welsh, cy; Xhosa, xh; "
    "Yiddish, yi; Yoruba, yo; Zulu, zu"
)  # name, code, other names

CURRENCIES = _rows("currencies", "currency", CURRENCY_ROWS, 0.4, ("en",))
LANGUAGES = _rows("languages", "language", LANGUAGE_ROWS, [0.4, 0.2, 0.4], ("en",))
NATIONALITIES = _rows("nationalities", "nationality", NATIONALITY_ROWS, 0.4, ("en",))
RELIGIONS = _rows("religions", "religion", RELIGION_ROWS, 0.4, ("en",))
CRYPTOCURRENCIES = _rows("cryptocurrencies", "currency", CRYPTOCURRENCY_ROWS, 0.4)

BUILT_IN = [CURRENCIES, LANGUAGES, NATIONALITIES, RELIGIONS, CRYPTOCURRENCIES]


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Terms:
    """One automaton over dictionaries; `most_terms` and `most_bytes` bound it."""

    def __init__(self, dictionaries: Iterable[Dictionary], most_terms: int = 1_000_000, most_bytes: int = 64 << 20):
        self.of: dict[str, tuple[Dictionary, float]] = {}
        for d in dictionaries:
            for t, score in d.terms:
                self.of.setdefault(t, (d, score))
        if len(self.of) > most_terms or sum(len(t.encode()) for t in self.of) > most_bytes:
            raise ValueError("dictionaries exceed their limits")
        self.automaton = ahocorasick.Automaton()
        for t in self.of:
            self.automaton.add_word(t, t)
        if self.of:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, Dictionary, float]]:
        """(start, end, dictionary, score) of each match."""
        if not self.of:
            return []
        out, upto = [], 0
        ends = sorted(((e + 1 - len(t), -len(t), t) for e, t in self.automaton.iter(text)))
        for start, size, t in ends:
            if start < upto:
                continue
            end = start - size
            upto = end
            d, score = self.of[t]
            if d.word_boundary and ((start and _word(text[start - 1])) or (end < len(text) and _word(text[end]))):
                continue
            out.append((start, end, d, score))
        return out
