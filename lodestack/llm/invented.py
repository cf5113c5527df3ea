"""Invented lines with personal information at known places, and with look-alikes, to train recognisers on.

A line is a frame around values. Half of the frames are written out, half are put together at random from cues
and plain words, so a model can learn what cues and formats mean but no sentence by heart. Names, streets and numbers
are drawn from lists of common ones, or made up from syllables or digits of any range.
"""

from __future__ import annotations

import random
import re

from lodestack.llm import lexicon

LANGUAGES = ("en", "de", "fr", "es", "ru", "zh")
#: Frames by kind and language; {} is the value's place.
FRAMES: dict[str, dict[str, tuple[str, ...]]] = {
    "name": {
        "en": ("My colleague {} will take over on Monday.", "{} wrote back yesterday", "Best, {}", "Have you met {} yet?", "cc: {}", "The report was checked by {} and {}.", "{} is on holiday until May.", "This was a talk with {}, who runs the lab.", "Attendees: {}, {} and {}", "Name: {}", "{} and {} argued about the plan", "We hired {} in spring.", "a letter from {}", "Minutes taken by {}", "Signed: {}", "Kind regards\n{}", "Yesterday {} fixed the roof.", "Patient {} arrived at noon.", "Players: {}; {}"),
        "de": ("Mit freundlichen Grüßen\n{}", "Das hat {} gestern bestätigt.", "Ansprechpartner: {}", "Bitte fragen Sie {} oder {}.", "{} arbeitet seit Mai bei uns.", "Der Brief kam von {}.", "Herr {} ist krank.", "Protokoll: {}", "Wir danken {} für die Hilfe.", "Teilnehmer: {}, {}"),
        "fr": ("Bien à vous, {}", "Le dossier suivi par {} est clos.", "{} a répondu hier.", "Contact : {}", "Monsieur {} est absent.", "Réunion avec {} et {}.", "Rédigé par {}", "Merci à {} pour son aide.", "Participants : {}, {}"),
        "es": ("Un saludo, {}", "El informe lo escribió {}.", "{} llegó ayer.", "Contacto: {}", "El señor {} está enfermo.", "Hablé con {} y con {}.", "Firmado: {}", "Gracias a {} por la ayuda.", "Participantes: {}, {}"),
        "ru": ("С наилучшими пожеланиями, {}", "Отчёт подготовил {}.", "{} ответил вчера.", "Контакт: {}", "Коллега {} в отпуске.", "Мы говорили с {} утром.", "Подпись: {}", "Благодарим {} за помощь.", "Участники: {}; {}"),
        "zh": ("请找{}确认一下。", "{}昨天已经回复了。", "姓名：{}", "我的同事{}下周休假。", "会议由{}主持，{}记录。", "这封信是{}写的。", "参加人：{}、{}", "感谢{}的帮助。", "{}先生正在出差。", "此事已经告诉{}了。", "他向{}借了一本书。", "作者{}，编辑{}。", "{}说明天不来。", "经办人：{}", "{}发现水管坏了。", "{}认为时间不够。", "与{}通话之后"),
    },
    "phone": {
        "en": ("You can ring me on {} any time.", "Phone: {}", "T {}", "Fax {}", "WhatsApp {}", "Office number is {}", "Emergency contact: {}", "text {} for details", "her new number: {}"),
        "de": ("Sie erreichen uns unter {}.", "Telefon: {}", "Handy {}", "Fax: {}", "Durchwahl {}", "meine Nummer ist {}"),
        "fr": ("Vous pouvez me joindre au {}.", "Téléphone : {}", "Portable {}", "Fax : {}", "mon numéro est le {}"),
        "es": ("Mi número es {}.", "Teléfono: {}", "Móvil {}", "Fax: {}", "llámame al {}"),
        "ru": ("Мой номер {}.", "Телефон: {}", "Моб. {}", "Факс: {}", "позвоните по номеру {}"),
        "zh": ("我的电话是{}。", "手机号：{}", "传真：{}", "联系方式：{}", "有事请拨打{}。", "座机{}"),
    },
    "id": {
        "en": ("SSN {}", "Passport number: {}", "His licence no. {} has expired.", "tax id {}", "NHS number {}", "identity card {}", "Insurance No: {}"),
        "de": ("Reisepass {}", "Personalausweis Nr. {}", "Steuernummer: {}", "Sozialversicherungsnummer {}", "Meine Steueridentifikationsnummer lautet {}."),
        "fr": ("Passeport n° {}", "Carte d’identité : {}", "Sécurité sociale : {}", "Numéro fiscal {}"),
        "es": ("Pasaporte: {}", "DNI {}", "con NIE {}", "Número de afiliación {}", "Documento de identidad {}"),
        "ru": ("Паспорт серия {}", "ИНН {}", "СНИЛС {}", "номер паспорта: {}", "полис {}"),
        "zh": ("身份证：{}", "护照号{}", "本人身份证号码为{}。", "证件{}已过期", "社保号：{}", "税号{}"),
    },
    "address": {
        "en": ("We live at {}.", "Ship to: {}", "Address:\n{}", "The shop at {} is closed", "visit us, {}", "He was last seen near {}.", "{}"),
        "de": ("Ich wohne in der {}.", "Lieferung an: {}", "Adresse: {}", "Das Büro ist in der {}.", "{}", "Treffpunkt {}", "Standort {}", "Filiale {} schließt", "Termin {} um zehn"),
        "fr": ("J’habite au {}.", "Envoyer à : {}", "Siège : {}", "Le magasin du {} est fermé.", "{}"),
        "es": ("Vivo en {}.", "Enviar a: {}", "Domicilio: {}", "La tienda de {} está cerrada.", "{}"),
        "ru": ("Живу по адресу {}.", "Доставка: {}", "Офис находится: {}.", "{}"),
        "zh": ("我住在{}。", "地址：{}", "公司位于{}。", "请送到{}，谢谢", "他家在{}", "会议地点是{}。", "地址是{}。", "他去{}看病。", "我在{}等你。"),
    },
    "email": {
        "en": ("Mail me: {}", "Contact {} for access", "E-mail {}", "{} is not reachable", "From: {}", "send it to {}.", "<{}>", "[{}]", "{};"),
        "de": ("Mail an {} genügt.", "E-Mail {}", "Fragen? {}"), "fr": ("Mél : {}", "envoyez à {}."), "es": ("Correo {}", "escríbeme a {}"),
        "ru": ("Почта {}", "пишите: {}"), "zh": ("电子邮件：{}", "发到{}即可", "我的邮箱是{}，请查收。"),
    },
}
#: Plain words and sentences without personal information.
PLAIN = {
    "en": "water paper garden music window letter winter history simple quiet early carry bring never always often table kitchen folder machine signal market weather lesson report copy garden under behind across finished started",
    "de": "wasser papier garten musik fenster brief winter einfach ruhig früh tragen immer oft tisch küche maschine markt wetter bericht kopie unter hinter fertig begonnen Haus Tisch Vorgang Ordner Anlage Prüfung Verzeichnis",
    "fr": "eau papier jardin musique fenêtre lettre hiver simple calme porter toujours souvent table cuisine machine marché rapport copie sous derrière fini commencé",
    "es": "agua papel jardín música ventana carta invierno simple tranquilo llevar siempre mesa cocina máquina mercado informe copia bajo detrás terminado",
    "ru": "вода бумага сад музыка окно письмо зима просто тихо рано нести всегда часто стол кухня машина рынок погода отчёт копия под готово",
    "zh": "水 纸 花园 音乐 窗户 信 冬天 简单 安静 经常 桌子 厨房 机器 市场 天气 报告 副本 已经 开始 完成 文件夹 路径 时间 方案 任务 程序 高级 应用 关于 常用 项目 石头 周末 管理 支持",
}
_WORDS = {k: v.split() for k, v in PLAIN.items()}
SENTENCES = {
    "en": ("The old library opens at nine.", "Version {n}.{n} fixes the login screen.", "Prices rose by {n} percent in {y}.", "Table {n} shows {n} rows.", "Figure {n}: Mean Annual Rainfall", "Happy New Year from the Green Valley Garden Club!", "Silver Moon Studio released Night Train Deluxe.", "Open Settings, Network and press Reset All.", "The Great Northern Hotel has {n} rooms.", "In May Berlin was cold.", "Read Chapter Seven, Page {n}.", "North Bank Holdings Ltd sold Blue River Mining.", "Cheese, Bread and Wine", "Dear Customer, your parcel is late.", "New York, Paris and Rome", "Press Enter to continue.", "Linux, Windows and Mac", "HTTP ERROR: SERVER NOT FOUND", "Big Data Team, Cloud Group", "Server Room {n}, Rack {n}", "Apollo Program, Saturn Rocket", "What The Manual Says: Save Often."),
    "de": ("Die Stadt Köln liegt am Rhein.", "Seite {n} von {n}", "Der Deutsche Bundestag tagt am Montag.", "Bitte Taste Start drücken.", "Im Jahr {y} kamen {n} Gäste.", "Schwarzer Tee, Grüner Tee", "Die Firma Neue Welt GmbH", "Haus Nummer {n} steht leer.", "Am Montag {n} Uhr", "Das Große Buch der Tiere, Band {n}"),
    "fr": ("Le Grand Hôtel ferme à {n} heures.", "Page {n} sur {n}", "La Banque de France publie ses chiffres.", "En mai Paris était calme.", "Société Bleu Ciel SARL", "Tome {n}, Chapitre Deux", "Les Trois Petits Cochons"),
    "es": ("El Gran Teatro abre a las {n}.", "Página {n} de {n}", "El Banco Central sube el tipo.", "En mayo Madrid estaba tranquila.", "Grupo Cielo Azul SL", "Capítulo Dos, Tomo {n}"),
    "ru": ("Большой Театр открыт до {n}.", "Страница {n} из {n}", "В мае Москва была тихой.", "ООО Новый Мир", "Белая Ночь, Красная Площадь", "Глава Вторая, том {n}"),
    "zh": ("图书馆九点开门。", "第{n}页共{n}页", "时间安排在周末，方案已经完成。", "任务完成之后关闭应用程序。", "高级用户常用的路径有{n}条。", "文件方面没有任何问题，于是关闭了项目。", "本周金额为{n}元，周期较长。", "安装包含{n}个文件，成功率很高。", "管理员支持全部方法。", "严格来说温度不高，向上调整即可。", "白天在石头路上马车很多。", "何时能够申请，万一失败怎么办？", "施工段落陆续完成，顾客可以查看雷达图。", "系统应该包括汤、包子和牛奶。", "索引程序常常没有成功，原因不明。", "云端高度安全，易于管理。", "左侧的按钮用于关闭窗口。", "康复期间应当安静，毛巾要干净。", "明天下午方便吗？龙头坏了。", "许多人认为文化课程太多。"),
}
BEFORE = lexicon.BEFORE_NAME.split()
#: Forms of numbers that aren't personal: # is a digit, ^ a letter.
_NUMBERS = (
    *("#" * n for n in (6, 7, 8, 9, 10, 11, 12, 13, 14, 16, 17)), "##/##/##", "###-####", "####-##-##", "20##-0#-1#", "19##-1#-2#", "1#.0#.20##", "2#.1#.19##", "##-##-##-^", "####-####-####", "### ### ###", "^^-######", "^^^#####",
    "###.###.###", "##########-#########", "############-##############", "##-###-####", "#-###-#####-#", "###-#-####-####-#", "^#########", "#,###,###", "## ## ##",
)
FILE_WORDS = "notes draft plan backup main index photo scan util core".split()
#: Characters that given names and towns are made of besides the lexicon's own.
HAN_TOWN = "海州宁京江南安平阳城山河津沙湖泉林昌兴庆云清临桂柳松白青金石长永新丰华武成"
HAN_STREET = ("人民", "中山", "解放", "建设", "和平", "文化", "长江", "胜利", "新华", "朝阳", "南京", "延安", "学院", "科技", "滨江", "花园", "迎宾", "体育场")
_SYLLABLES = "ba be bo ca co da de do fa fe ga go ha he jo ka ki ko la le lo ma me mi mo na ne no pa pe po ra re ri ro sa se so ta te ti to va ve vi wa we ya yo za ze".split()
_ENDS = ("n", "r", "s", "l", "ck", "ston", "field", "berg", "mann", "ski", "ez", "ard", "eau", "sen", "ford", "well", "ton", "er", "in", "is", "lund", "stein")


class Invented:
    """Lines drawn at random; equal seeds give equal lines."""

    def __init__(self, seed: int, frames: dict | None = None):
        self.r = random.Random(seed)
        self.frames = frames or FRAMES
        self.given = {
            "en": lexicon.GIVEN_ENGLISH + lexicon.GIVEN_OTHER, "de": lexicon.GIVEN_GERMAN, "fr": lexicon.GIVEN_FRENCH, "es": lexicon.GIVEN_SPANISH,
            "ru": lexicon.GIVEN_RUSSIAN,
        }
        self.given = {k: [w for w in v.split() if (w[0] >= "а") == (k == "ru")] for k, v in self.given.items()}
        families = lexicon.FAMILY.split()
        self.families = {True: [w for w in families if w[0] >= "а"], False: [w for w in families if w[0] < "а"]}

    def digits(self, n: int) -> str:
        return str(int(self.r.random() * 10**n)).zfill(n)

    def letters(self, n: int) -> str:
        return "".join("ABCDEFGHJKLMNPRSTUVWXYZ"[int(self.r.random() * 23)] for _ in range(n))

    def fill(self, form: str) -> str:
        return "".join(self.digits(1) if c == "#" else self.letters(1) if c == "^" else c for c in form)

    def made_up(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 3))) + self.r.choice(("", self.r.choice(_ENDS)))

    def plain(self, language: str, low: int = 1, high: int = 4) -> str:
        words = _WORDS[language]
        return ("" if language == "zh" else " ").join(self.r.choice(words) for _ in range(self.r.randint(low, high)))

    def sentence(self, language: str) -> str:
        out = self.r.choice(SENTENCES[language])
        while "{n}" in out:
            out = out.replace("{n}", str(self.r.randint(1, self.r.choice((9, 99, 9999)))), 1)
        return out.replace("{y}", str(self.r.randint(1950, 2030)))

    def capital(self, word: str) -> str:
        return "-".join(p[:1].upper() + p[1:] for p in word.split("-"))

    def family(self, language: str) -> str:
        r = self.r
        if r.random() < 0.25:
            out = self.capital(r.choice(self.families[language == "ru"]))
        elif language == "ru":
            out = self.capital("".join(r.choice("ба бе во го да же зо ки ла ме на по ро са те хо чу ша".split()) for _ in range(2))) + r.choice(("в", "нов", "нин", "ский", "хова", "енко", "лик", "рец"))
        else:
            out = self.capital(self.made_up())
            if language in ("de", "fr", "es") and r.random() < 0.3:
                at = r.randrange(len(out))
                out = out[:at] + r.choice("äöüéèñçôáí") + out[at:]
                out = self.capital(out)
        odd = r.random()
        if odd < 0.08:
            out += "-" + self.capital(self.made_up())
        elif odd < 0.13:
            out = out.upper()
        elif odd < 0.2 and language != "ru":
            out = r.choice(("von ", "de ", "van der ", "de la ", "Mc", "O’", "Al-", "Di ")) + out
        return out

    def name(self, language: str) -> str:
        r = self.r
        if language == "zh":
            if r.random() < 0.3:
                return r.choice(lexicon.COMPOUND.split()) + "".join(r.choice(lexicon.GIVEN_HAN + HAN_TOWN) for _ in range(r.choice((1, 2, 2))))
            given = "".join(r.choice(lexicon.GIVEN_HAN) for _ in range(r.choice((1, 2, 2))))
            return r.choice(lexicon.SURNAMES[:100] if r.random() < 0.8 else lexicon.SURNAMES) + given
        given = self.capital(r.choice(self.given[language]))
        if r.random() < 0.08:
            given = self.capital(self.made_up())
        if language in ("fr", "de", "es") and r.random() < 0.08:
            given += "-" + self.capital(r.choice(self.given[language]))
        family, letter = self.family(language), r.choice("АБВГДЕКЛМНПРСТ" if language == "ru" else "ABCDEFGHIJKLMNPRSTVW")
        forms = (
            (12, f"{given} {family}"), (3, f"{family}, {given}"), (2, f"{letter}. {family}"), (2, f"{given} {letter}. {family}"), (1.5, f"{given} {letter}."),
            (1, f"{family} {given}"), (0.7, f"{letter}. {letter}. {family}"), (0.7, f"{given} {self.capital(r.choice(self.given[language]))} {family}"), (0.7, f"{family}, {letter}."),
        )
        return r.choices([f for _, f in forms], [w for w, _ in forms])[0]

    def grouped(self, sizes: list[int], between: str) -> str:
        return between.join(self.digits(n) for n in sizes)

    def phone(self, language: str) -> str:
        r, sep = self.r, self.r.choice((" ", "-", ".", " ", ""))
        sizes = r.choice(([3, 3, 4], [3, 4, 4], [2, 2, 2, 2], [4, 6], [3, 7], [5, 6], [4, 3, 3], [3, 3, 2, 2], [3, 2, 2], [3, 4], [2, 4, 4], [5, 3, 3], [3, 8], [2, 3, 2, 2], [2, 8], [5, 3]))
        body = self.grouped(sizes, sep)
        kind = r.random()
        if kind < 0.25:
            return "+" + r.choice((self.digits(1), self.digits(2), self.digits(3))) + r.choice((" ", " ", "-", "")) + (f"({self.digits(r.randint(1, 4))}) " if r.random() < 0.3 else "") + body
        if kind < 0.45:
            return f"({self.digits(r.randint(3, 5))})" + r.choice((" ", "", "-", " ")) + self.grouped(r.choice(([3, 4], [7], [3, 2, 2], [6], [4, 4], [5, 3], [8], [3, 3])), r.choice((" ", "-")))
        if kind < 0.52 and language == "zh":
            return "1" + r.choice((self.digits(10), f"{self.digits(2)} {self.digits(4)} {self.digits(4)}", f"{self.digits(2)}-{self.digits(4)}-{self.digits(4)}"))
        if kind < 0.75:
            return "0" + r.choice((f"{self.digits(r.randint(1, 4))}{r.choice('/ -')}{self.digits(r.randint(4, 8))}", f"{self.digits(1)}{sep or ' '}" + self.grouped([2, 2, 2, 2], sep or " "), f"{self.digits(r.randint(2, 4))} {self.digits(r.randint(3, 5))}-{self.digits(r.randint(1, 3))}", "0" + self.digits(2) + " " + self.grouped(r.choice(([2, 8], [3, 6], [2, 5, 3], [1, 2, 2, 2, 2])), " ")))
        if kind < 0.8 and language == "ru":
            return r.choice(("8", "+7")) + r.choice((f" ({self.digits(3)}) {self.digits(3)}-{self.digits(2)}-{self.digits(2)}", f"-{self.digits(3)}-{self.digits(3)}-{self.digits(4)}", f" {self.digits(3)} {self.digits(3)} {self.digits(2)} {self.digits(2)}"))
        return body if sum(sizes) > 6 else "0" + body

    def identity(self, language: str) -> str:
        d, up, r = self.digits, self.letters, self.r
        birth = f"{r.randint(1930, 2012)}{r.randint(1, 12):02}{r.randint(1, 28):02}"
        by = {
            "en": (f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{up(2)} {d(2)} {d(2)} {d(2)} {up(1)}", f"{up(2)}{d(6)}{up(1)}", f"{up(1)}{d(8)}", f"{up(2)}{d(7)}", f"{d(9)}", f"{d(3)} {d(3)} {d(4)}"),
            "de": (f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(11)}", f"{up(1)}{d(2)}{up(1)}{d(2)}{up(1)}{d(2)}", f"{up(2)}{d(2)}{up(1)}{d(2)}{up(1)}{d(1)}", f"{up(1)}{d(1)}{up(2)}{d(3)}{up(1)}{d(1)}", f"{d(2)} {d(6)} {up(1)} {d(3)}", f"{up(1)}{d(8)}"),
            "fr": (f"{r.choice('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"{r.choice('12')}{d(14)}", f"{d(2)}{up(2)}{d(5)}", f"{d(12)}"),
            "es": (f"{d(8)}{up(1)}", f"{d(8)}-{up(1)}", f"{r.choice('XYZ')}{d(7)}{up(1)}", f"{r.choice('XYZ')}-{d(7)}-{up(1)}", f"{up(3)}{d(6)}"),
            "ru": (f"{d(3)}-{d(3)}-{d(3)} {d(2)}", f"{d(2)} {d(2)} {d(6)}", f"{d(4)} {d(6)}", f"{d(12)}", f"{d(10)}"),
            "zh": (f"{d(6)}{birth}{d(3)}{r.choice('0123456789X')}",) * 3 + (f"{up(1)}{d(8)}", f"{up(2)}{d(7)}"),
        }
        return r.choice(by[language])

    def email(self) -> str:
        r = self.r
        given = r.choice(self.given["en"])
        local = r.choice((given, f"{given}.{self.made_up()}", f"{given[0]}{self.made_up()}", f"{given}_{self.made_up()}", f"{self.made_up()}{self.digits(2)}", f"{self.capital(given)}.{self.capital(self.made_up())}", f"{given}+{self.made_up()}", f"{self.made_up()}.{given[0]}", r.choice(("info", "office", "sales", "x", "team-a"))))
        top = r.choice(("com", "org", "net", "de", "fr", "es", "ru", "cn", "io", "co.uk", "edu", "gov", "info", "example", "test", "invalid", "local"))
        host = r.choice((f"{self.made_up()}.{top}", f"mail.{self.made_up()}.{top}", f"{self.made_up()}-{self.digits(1)}.{top}", f"{r.choice('abcxyz')}.{r.choice('abcxyz')}.{top}", f"example.{top}", f"{self.made_up()}.example"))
        if r.random() < 0.1:
            host = host.upper()
        at, dot = r.choices((("@", "."), (" @ ", "."), ("＠", "."), (" (at) ", "."), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" at ", " dot "), (" AT ", " DOT "), ("{at}", ".")), (8, 1, 1, 1, 1, 1, 1, 1, 0.5, 0.5))[0]
        return (local if dot == "." or r.random() < 0.5 else local.replace(".", dot)) + at + host.replace(".", dot)

    def address(self, language: str) -> str:
        r, n = self.r, self.r.randint(1, self.r.choice((30, 300, 2000)))
        town, word, code = self.capital(self.made_up()), self.capital(self.made_up()), self.digits(5)
        after = r.choice(("", "", f", {town}", f", {code} {town}", f", {town} {code}"))
        if language == "en":
            street = self.capital(r.choice(lexicon.STREET_AFTER.split()))
            front = r.choice(("", "", "", "", "Old ", "North ", "St. ", "W "))
            tail = r.choice(("", "", f", Apt {n}", f", Flat {n % 9}", f", Suite {n}")) + r.choice(("", f", {town}", f", {town} {code}", f", {town}, {self.letters(2)} {code}", f", {town}, {self.letters(2)}{n % 9} {n % 7}{self.letters(2)}", f"\n{town} {self.letters(2)}{n % 9} {n % 7}{self.letters(2)}"))
            return f"{n}{r.choice(('', '', '', 'A', 'b'))} {front}{word} {street}{r.choice(('', '', '.')) if len(street) < 5 else ''}{tail}"
        if language == "de":
            ending = r.choice(lexicon.STREET_ENDINGS.split()[:17])
            street = r.choice((f"{word}{ending}", f"{word}{ending}", f"{r.choice(('Alte', 'Neue', 'Obere', 'Lange', 'Kleine'))} {word}{ending}", f"{word}-{town}-{self.capital(ending)}", f"{r.choice(('Am', 'An der', 'Auf dem', 'Zum', 'Unter den', 'Im'))} {r.choice(('Alten ', '', 'Hohen '))}{word}"))
            place = r.choice(("", f", {code} {town}", f" in {town}", f"\n{code} {town}", f", {town}"))
            return f"{street} {n}{r.choice(('', '', 'a', ' b'))}" + (place or (f", {code} {town}" if street[:3] in ("Am ", "An ", "Auf", "Zum", "Unt", "Im ") else ""))
        if language == "fr":
            return f"{n}{r.choice(('', '', ' bis', ' ter'))}{r.choice(('', ','))} {r.choice(lexicon.STREET_BEFORE_FR.split())} {r.choice(('de la ', 'du ', 'des ', 'de ', 'Saint-', '', 'de l’', 'du Grand '))}{word}" + r.choice(("", f", {code} {town}", f" - {code} {town}", f", {town}", f" à {town}"))
        if language == "es":
            street = r.choice(("Calle", "C/", "C.", "Avda.", "Avenida", "Plaza", "Paseo", "Camino", "Ronda", "Via", "Viale", "Rua"))
            return f"{street} {r.choice(('de la ', 'del ', 'de ', '', ''))}{word}{r.choice(('', ' Mayor', ' Viejo'))}{r.choice((', ', ' ', ' nº ', ', núm. '))}{n}{r.choice(('', ', 2.º A', ', 3º B'))}{after}"
        if language == "ru":
            name = self.capital("".join(r.choice("бе ве го ле ма ни по ро са ту".split()) for _ in range(2)))
            kind = r.choice(("ул.", "улица", "пр.", "проспект", "пер.", "наб.", "бульвар"))
            town = self.capital("".join(r.choice("бо во го ко ле ми но ор пе се ту".split()) for _ in range(2))) + r.choice(("", "ск", "град", "поль"))
            core = r.choice((f"{kind} {name}{r.choice(('ва', 'ная', 'ского'))}, {r.choice(('', 'д. ', 'дом '))}{n}", f"{name}ная {kind}, {r.choice(('', 'д. '))}{n}"))
            return r.choice(("", f"г. {town}, ", "")) + core + r.choice(("", f", кв. {n % 90}", f", корп. {n % 4 + 1}")) + r.choice(("", f", г. {town}", f", {town}"))
        town = "".join(r.choice(HAN_TOWN) for _ in range(2))
        district = r.choice(("", "", "".join(r.choice(HAN_TOWN) for _ in range(r.choice((1, 2)))) + r.choice("区县区")))
        street = r.choice(HAN_STREET) if r.random() < 0.6 else "".join(r.choice(HAN_TOWN) for _ in range(r.choice((2, 3))))
        return r.choice((f"{town}市{district}", f"{town}市{district}", f"{''.join(r.choice(HAN_TOWN) for _ in range(2))}省{town}市{district}", "")) + street + r.choice(("东", "西", "", "", "")) + r.choice(("路", "街", "大道", "巷", "路")) + f"{n}号" + r.choice(("", f"{n % 20 + 1}楼", f"{n % 9 + 1}栋{n % 900 + 100}室", f"{n % 5 + 1}单元"))

    def decoy(self, language: str) -> str:
        """A line with numbers, signs or capitals that are no personal information."""
        d, r, w = self.digits, self.r, self.made_up
        number = self.fill(r.choice(_NUMBERS))
        counted = {"en": lexicon.COUNTED.split("\n")[1], "de": lexicon.COUNTED.split("\n")[2], "fr": lexicon.COUNTED.split("\n")[3], "es": lexicon.COUNTED.split("\n")[4], "ru": lexicon.COUNTED.split("\n")[5], "zh": lexicon.HAN_COUNTED}[language].split()
        word = r.choice(counted)
        space = "" if language == "zh" else " "
        pick = r.random()
        if pick < 0.35:
            return r.choice((f"{word}{space}{number}", f"{self.capital(word)}{space}{number}", f"{self.plain(language)}{space}{word}: {number}", f"{word} no. {number} {self.plain(language)}", f"{self.plain(language)}{space}{number}{space}{r.choice(counted)}", f"{number}{space}{r.choice(counted)}", f"{self.capital(word)} {self.plain(language, 1, 2)} {number}, {self.plain(language)}"))
        if pick < 0.5:
            return r.choice((
                f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)} 1{d(1)}:2{d(1)}:3{d(1)} {self.plain(language)}", f"{d(3)}.{d(2)}.{d(1)}.{d(3)}", f"10.{d(1)}.{d(2)}.{d(2)}:8080", f"{d(2)}:{d(2)}:{d(2)}", f"0x{d(8)}", f"{w()}{d(8)}", f"{w()}_{d(10)}.log", f"{d(7)} {self.plain(language)}", f"{d(1)}.{d(2)}.{d(3)}.{d(4)}", f"{d(6)}{w()[:2]}{d(6)}", f"1{d(1)}.0{d(1)}.20{d(2)} {self.plain(language)}", f"{self.plain(language)} 0{d(1)}/20{d(2)}",
            ))
        if pick < 0.62:
            return r.choice((
                f"{r.choice(FILE_WORDS)}@{d(1)}.{d(2)}.{d(1)}", f"{w()}@{d(1)}x.png", f"git@{w()}.com:{w()}/{w()}.git", f"ssh {w()}@{w()}:~/{w()}", f"@{w()} {self.plain(language)}", f"{self.plain(language)} @{w()}.", f"{w()}@{w()}", f"npm i {w()}@{d(1)}.{d(1)}", f"{self.plain(language)} at {w()}.{r.choice(('com', 'org'))}", f"meet at {w()} dot", f"{w()} [at] {w()}", f"https://{w()}.com/@{w()}", f"{w()}@{d(2)}.{d(2)}.{d(1)}-rc", f"{d(2)} @ {d(2)}.{d(2)}", f"{w()}@{w()}.{r.choice(('png', 'zip', 'rs', 'json'))}",
            ))
        if pick < 0.78:
            c = self.capital
            return r.choice((
                f"{c(self.plain(language, 1, 1))} {c(w())} {c(self.plain(language, 1, 1))}", f"the {c(w())} {c(w())} {r.choice(lexicon.ORGANISATION.split())}", f"{c(w())} {c(r.choice(lexicon.ORGANISATION.split()[:90]))}", f"{c(r.choice(lexicon.COMMON.split()))} {c(w())} {self.plain(language)}", f"{c(r.choice(lexicon.COMMON.split()))} {r.choice('ABCDFGZ')}:\\{c(w())}\\{c(w())}.txt", f"{c(r.choice(_WORDS[language]))} {r.choice('ABCDFGZ')}{r.choice((':', ',', ':/', ' -', ''))}{space}{self.plain(language)}", f"{c(r.choice(counted))} {r.choice('ABCDFGZ')}{r.choice((':', '.', ','))} {c(self.plain(language))}", f"“{c(w())} {c(w())}”", f"{c(w())} {c(w())} {d(2)}.{d(1)}",
                f"{c(w())}. {c(w())} {self.plain(language)}", f"{w()} {self.plain(language)} {c(w())}: {c(r.choice(lexicon.COMMON.split()))}", f"{c(self.plain(language, 1, 1))} {c(self.plain(language, 1, 1))} {c(self.plain(language, 1, 1))}".upper(), f"{c(r.choice(lexicon.COMMON.split()))}, {c(w())} {self.plain(language)}", f"{self.plain(language)} {c(w())} {c(r.choice(lexicon.COMMON.split()))} {self.plain(language)}",
                f"{self.plain(language)} {c(self.plain(language, 1, 1))} {r.choice(lexicon.PARTICLE.split())} {c(self.plain(language, 1, 1))} {self.plain(language)}", f"{c(w())} {r.choice(lexicon.PARTICLE.split())} {c(self.plain(language, 1, 1))}",
                f"{r.choice(BEFORE).strip()} {c(w())} {c(w())} {c(r.choice(lexicon.ORGANISATION.split()))}{r.choice((',', '', '.', ' ' + d(1)))} {self.plain(language)}", f"{self.plain(language)} {r.choice('ABCDEFGHXZ')}. {c(r.choice(counted))} {d(r.randint(1, 4))}", f"{self.plain(language)} {r.choice('ABCDEFGHXZ')}. {c(self.plain(language, 1, 1))} {d(r.randint(1, 12))} {self.plain(language)}",
                f"{self.plain(language)} {r.choice('ABCDEFGHXZ')}. {c(r.choice(lexicon.COMMON.split()))} {self.plain(language)}", f"{self.plain(language)} {r.choice('ABCDEFGHXZ')}. {c(self.plain(language))}", f"{self.plain(language)} {r.choice('ABCDEFGHXZ')}. {c(r.choice(lexicon.COMMON.split()))} {c(w())} {self.plain(language)}",
                f"{c(r.choice(lexicon.GIVEN_ENGLISH.split()))} {c(r.choice(lexicon.ORGANISATION.split()))}", f"{self.plain(language)} {c(r.choice(self.given['en']))}. {c(r.choice(lexicon.COMMON.split()))} {self.plain(language)}", f"{c(r.choice(lexicon.BEFORE_NAME.split()))}, {c(r.choice(self.given['en']))}", f"{c(self.plain(language, 1, 1))} {d(4)} {c(w())}",
            ))
        return self.sentence(language)

    def assembled(self, kind: str, language: str) -> str:
        """A frame of cues and plain words in random order and distance."""
        cues = {"phone": lexicon.PHONE, "id": lexicon.IDENTITY, "address": lexicon.ADDRESS, "name": lexicon.BEFORE_NAME, "email": "mail e-mail email contact"}[kind]
        rows = [x for x in cues.split("\n") if x]
        row = rows[min(("en", "de", "fr", "es", "ru").index(language), len(rows) - 1)].split() if language != "zh" else {"phone": lexicon.HAN_PHONE, "id": lexicon.HAN_IDENTITY, "address": lexicon.HAN_ADDRESS, "name": lexicon.HAN_BEFORE_NAME, "email": "邮箱"}[kind].split()
        space = "" if language == "zh" else " "
        r = self.r
        parts = [self.plain(language, 0, 3)] if r.random() < 0.6 else []
        has_cue = r.random() < (0.92 if kind in ("phone", "id") else 0.75)
        if has_cue:
            cue = r.choice(row)
            parts.append(self.capital(cue) if r.random() < 0.3 else cue)
            if r.random() < 0.3:
                parts.append(self.plain(language, 1, 2))
        head = space.join(p for p in parts if p)
        head += r.choice((": ", " ", "：", "，", "")) if language == "zh" else r.choice((": ", " ", " ", ", ", ":\n")) if head else ""
        after = lexicon.HAN_AFTER_NAME.split() if language == "zh" else [x for x in lexicon.AFTER_NAME.split("\n") if x][min(("en", "de", "fr", "es", "ru").index(language), 4)].split()
        tail = r.choice(("", ".", " " + self.capital(self.plain(language)), space + self.plain(language), ", " + self.plain(language), "\n"))
        if kind == "name" and r.random() < (0.4 if has_cue else 0.85):
            tail = space + r.choice(after) + space + self.plain(language)
        if kind == "name" and r.random() < 0.2 and language != "zh":
            head += self.capital(r.choice([x for x in lexicon.TITLE.split() if len(x) < 7])) + r.choice((". ", " "))
            if r.random() < 0.35:
                head += r.choice("ABCDEFGHIJKLMNPRSTVW") + ". "
                return head[:-3] + "{" + head[-3] + "}" + tail
        return head + "{}" + tail

    def several(self) -> str:
        """A frame of a list, as in a heading of minutes."""
        r = self.r
        return r.choice(("{}; {}", "{}; {}; {}", "{}, {}", "{}; {}; {}; {}", "{}\n{}\n{}", "{} | {}", "{}; {}")) + r.choice(("", "", ".", "\n"))

    def line(self, written: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
        """A text and its spans (kind, start, end). written: only frames that are written out."""
        r = self.r
        language = r.choice(LANGUAGES)
        if r.random() < 0.35:
            return self.decoy(language) + r.choice(("", " ", "\n")) + self.decoy(language), []
        kind = r.choices(("email", "phone", "id", "address", "name"), (2, 3, 3, 3, 6))[0]
        frame = r.choice(self.frames[kind][language]) if written or r.random() < 0.5 else self.assembled(kind, language)
        if kind == "name" and not written and r.random() < 0.12:
            cues = [x for x in lexicon.BEFORE_NAME.split("\n") if x][min(LANGUAGES.index(language), 4)].split() if language != "zh" else lexicon.HAN_BEFORE_NAME.split()
            frame = r.choice((self.capital(r.choice(cues)) + r.choice((": ", " : ", "："), ), "")) + self.several()
        text = r.choice(("", "", "", self.decoy(language) + r.choice((" ", "\n", ". ")), self.sentence(language) + r.choice((" ", "\n"))))
        spans, rest = [], frame
        marked = re.search(r"\{([A-Z])\}", rest)  # an initial is wanted
        if marked:
            rest = rest.replace(marked[0], "{}")
        while "{}" in rest:
            head, _, rest = rest.partition("{}")
            text += head
            value = f"{marked[1]}. {self.family(language)}" if marked else {"email": self.email, "phone": lambda: self.phone(language), "id": lambda: self.identity(language), "address": lambda: self.address(language), "name": lambda: self.name(language)}[kind]()
            if value.endswith(".") and rest.startswith("."):
                rest = rest[1:]
            spans.append((kind, len(text), len(text) + len(value)))
            text += value
        other = r.choice(LANGUAGES)
        text += rest + r.choice(("", "\n", " " + self.sentence(language), "\n" + self.decoy(language), " " + self.decoy(language), " " + self.sentence(other), r.choice(("", " ")) + self.decoy(other)))
        return text, spans
