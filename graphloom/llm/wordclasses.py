"""Function words of nine languages by class, as fixed values, and the classes of other tokens."""

from __future__ import annotations

import re

#: Common function words; a word in several classes counts in the first.
FUNCTION_WORDS = {
    "article": "the a an der die das den dem des ein eine einen einem einer eines le la les un une des l' el los las una unos unas o os as um uma uns umas il lo gli i",
    "preposition": "of in on at by for with from into to between during after before under over about against without within through than per "
    "von in im an am auf aus bei mit nach seit zu zum zur für durch gegen ohne um über unter vor hinter neben zwischen "
    "de du à au aux en dans sur sous pour par avec sans entre chez vers depuis pendant avant après del al con por para sin sobre entre desde hasta "
    "do da dos das no na nos nas ao aos à às pelo pela em com sem até di del dello della dei degli delle nel nella nei nelle sul sulla dal dalla dai al allo alla ai agli alle con su per tra fra "
    "в во на с со к ко по из за от до о об у при без для над под через между после перед",
    "pronoun": "it its this that these those they them their he she his her we us our you your i me my who which what each every all some any nobody everybody one itself themselves there both either "
    "er sie es wir ihr ihn ihm ihnen sein seine ihre unser dieser diese dieses jeder jede jedes alle allen sämtliche man sich was wer welche "
    "il elle on nous vous ils elles ce cet cette ces son sa ses leur leurs chaque tous toutes tout qui que quoi dont où "
    "él ella ellos ellas esto este esta estos estas ese esa su sus cada todos todas todo quien lo se ele ela eles elas este esta isto seu sua seus suas cada todos todas tudo quem "
    "esso essa essi egli lui lei loro questo questa questi queste suo sua suoi sue ogni tutti tutte tutto chi ci ne si "
    "он она оно они его её их мы вы я это этот эта эти каждый каждая каждое каждую все всё свой своя который которая которые что кто себя",
    "conjunction": "and or but if because when while although unless until since so whether once where as otherwise und oder aber wenn weil dass daß damit falls sobald obwohl während sonst als bevor nachdem "
    "et ou mais si parce car lorsque quand puisque afin dès quoique alors que y e o u pero si porque cuando mientras aunque pues como e ou mas se porque quando enquanto embora pois como mesmo assim "
    "e o ma se perché quando mentre anche affinché altrimenti appena prima come poiché и или а но если потому когда чтобы как хотя пока иначе даже так",
    "auxiliary": "is are was were be been being am do does did has have had can could may might must shall should will would ist sind war waren wird werden wurde hat haben kann können muss müssen soll darf "
    "est sont était ont a été être peut doit es son era fue ha han puede debe está están hay é são era foi tem têm pode deve está estão è sono era stato stata ha hanno può deve viene быть был была было были есть может должен нет",
    "adverb": "not no never only also still then again too very much more most less just even yet other already nicht kein keine nur auch noch schon sehr mehr wieder dann ne pas plus aussi encore même très déjà seulement "
    "no más también aún muy ya sólo solo não mais também ainda muito já só non più anche ancora molto già solo не ни уже ещё только также очень больше",
}
CLASSES = [*FUNCTION_WORDS]
_WORDS: dict[str, int] = {}
for _k, _c in enumerate(CLASSES):
    for _w in FUNCTION_WORDS[_c].split():
        _WORDS.setdefault(_w, _k)
#: Grammatical characters of Chinese.
HAN_FUNCTION = set("的了在是和就都而被把从这那之不每个会已经并且否则如果即使只要然后因为所以也还又对于与及其或者可以可能上下中里向到给让使比跟")
OTHERS = ["hiragana", "han grammar", "han", "katakana", "word", "capital", "code word", "number", "link", "tag", "end", "comma", "colon", "bracket", "quote", "bar", "dash", "sign", "line", "start"]
IDS = {name: i for i, name in enumerate([*CLASSES, *OTHERS])}
SIZE = len(IDS)
_CJK = "぀-ヿ㐀-鿿"
TOKEN = re.compile(rf"https?://[^\s<>\"')\]]+|\#\w+|[ぁ-ゟ]|[゠-ヿ]+|[㐀-鿿]|[^\W\d_{_CJK}]+(?:['’][^\W\d_{_CJK}]+)?(?:[_\d][\w]*)?|\d[\d.,:]*|[^\w\s]|_+|\n")
_PUNCT = {c: n for n, cs in {"end": ".!?。！？…", "comma": ",，、;；", "colon": ":：", "bracket": "()[]{}<>（）「」", "quote": "\"'`’“”«»", "bar": "|·•/\\", "dash": "-–—*+~", "line": "\n"}.items() for c in cs}


class TokenClass(dict):
    """Token to the number of its class; tokens of ordinary length are remembered up to a bound."""

    def __missing__(self, t: str) -> int:
        k = IDS[self.name_of(t)] if (w := _WORDS.get(t.lower())) is None else w
        if len(t) < 30:
            if len(self) > 300_000:
                self.clear()
            self[t] = k
        return k

    @staticmethod
    def name_of(t: str) -> str:
        c = t[0]
        if t.startswith("http"):
            return "link" if ":" in t else "word"
        if c == "#" and len(t) > 1:
            return "tag"
        if (p := _PUNCT.get(c)) and (len(t) == 1 or c in "._"):
            return p
        if "ぁ" <= c <= "ゟ":
            return "hiragana"
        if "゠" <= c <= "ヿ":
            return "katakana"
        if "㐀" <= c <= "鿿":
            return "han grammar" if c in HAN_FUNCTION else "han"
        if c.isdigit():
            return "number"
        if c.isalpha():
            return "code word" if any(x.isdigit() or x == "_" for x in t) or t[1:] != t[1:].lower() and t != t.upper() else "capital" if c != c.lower() else "word"
        return "sign"
