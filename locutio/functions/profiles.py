"""Trigram rank profiles of languages, made by a rule from short seed texts, and the scripts that tell other languages.

Near languages (Danish and Swedish, Spanish and Galician) may be confused on a single sentence."""

from __future__ import annotations

import re
from collections import Counter

from .languages import FUNCTION_WORDS

#: Ranks that a profile has; the most frequent trigram weighs this much, the next one less.
RANKS = 300

# Seed texts, the first article of the Universal Declaration of Human Rights (public domain).
SEEDS = {
    "af": "Alle menslike wesens word vry, met gelyke waardigheid en regte, gebore. Hulle het rede en gewete en behoort in die gees van broederskap teenoor mekaar te handel.",
    "bg": "Всички хора се раждат свободни и равни по достойнство и права. Те са надарени с разум и съвест и следва да се отнасят помежду си в дух на братство.",
    "ca": "Tots els éssers humans neixen lliures i iguals en dignitat i en drets. Són dotats de raó i de consciència, i han de comportar-se fraternalment els uns amb els altres.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství.",
    "da": "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen.",
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
    "et": "Kõik inimesed sünnivad vabadena ja võrdsetena oma väärikuselt ja õigustelt. Neile on antud mõistus ja südametunnistus ja nende suhtumist üksteisesse peab kandma vendluse vaim.",
    "eu": "Gizon-emakume guztiak aske jaiotzen dira, duintasun eta eskubide berberak dituztela; eta ezaguera eta kontzientzia dutenez gero, elkarren artean senide legez jokatu beharra dute.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
    "gl": "Tódolos seres humanos nacen libres e iguais en dignidade e dereitos e, dotados como están de razón e conciencia, díbense comportar fraternalmente uns cos outros.",
    "hr": "Sva ljudska bića rađaju se slobodna i jednaka u dostojanstvu i pravima. Ona su obdarena razumom i sviješću i trebaju jedna prema drugima postupati u duhu bratstva.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
    "id": "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
    "lt": "Visi žmonės gimsta laisvi ir lygūs savo orumu ir teisėmis. Jiems suteiktas protas ir sąžinė ir jie turi elgtis vienas kito atžvilgiu kaip broliai.",
    "lv": "Visi cilvēki piedzimst brīvi un vienlīdzīgi savā pašcieņā un tiesībās. Viņi ir apveltīti ar saprātu un sirdsapziņu, un viņiem jāizturas citam pret citu brālības garā.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen.",
    "no": "Alle mennesker er født frie og med samme menneskeverd og menneskerettigheter. De er utstyrt med fornuft og samvittighet og bør handle mot hverandre i brorskapets ånd.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade.",
    "ro": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "sk": "Všetci ľudia sa rodia slobodní a sebe rovní, čo sa týka ich dôstojnosti a práv. Sú obdarení rozumom a svedomím a majú navzájom jednať v bratskom duchu.",
    "sr": "Сва људска бића рађају се слободна и једнака у достојанству и правима. Она су обдарена разумом и свешћу и треба једни према другима да поступају у духу братства.",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De har utrustats med förnuft och samvete och bör handla gentemot varandra i en anda av gemenskap.",
    "sw": "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu.",
    "tl": "Ang lahat ng tao'y isinilang na malaya at pantay-pantay sa karangalan at mga karapatan. Sila'y pinagkalooban ng katwiran at budhi at dapat magpalagayan ang isa't isa sa diwa ng pagkakapatiran.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "uk": "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства.",
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. Mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu.",
}

#: Function words, beside those that the other detection counts.
MORE_WORDS = {
    "af": "die van en het nie is wat om te sy hulle ook maar vir deur was daar kan",
    "bg": "и на да се е в за не от са с по че като това до ще си които но",
    "ca": "el la els les i de que en un una per amb no és del al més com aquest però seva",
    "cs": "a je se na v že s z do o to jako ale jsou za pro by byl jeho který také",
    "da": "og i at det er en til af på for med som ikke den der de har et om fra var jeg vi kan så efter ud når op hvor havde meget ved end alle også skulle hvad gamle",
    "et": "ja on ei et see oli ka kui aga mis ning oma või siis kes ta nii pole veel",
    "eu": "eta da ez bat du dute baina hau izan dira edo ere zuen bere egin den horrek",
    "fi": "ja on ei se että oli hän mutta myös kun niin tai ovat joka sen olla kuin vain mukaan",
    "gl": "o a os as e de que en un unha para con non se do da polo pola máis como ao",
    "hr": "i je u na se da su za od s kao što nije ili ali koji bi to će biti iz",
    "hu": "a az és hogy nem egy is volt de meg csak van ez mint azt ki már még vagy kell",
    "id": "yang dan di ini itu dengan untuk dari pada tidak adalah dalam akan ke juga oleh mereka telah karena",
    "lt": "ir kad yra su iš tai į ne kaip apie buvo bet tik jis dėl po prie savo jo",
    "lv": "un ir ka ar no tas par uz kā bet arī vai tika lai pēc viņš šis nav kas",
    "nl": "de het een en van in is dat op te niet met voor zijn die aan er ook als maar hij heeft wat bij naar nog wel wordt over uit dan door zo maar kan hun was werd geen deze waar oude",
    "no": "og i det er en til av på for med som ikke at den har de et om fra var jeg ikke vi kan så etter ut når opp hvor hadde mye ved enn alle også skulle hva gamle",
    "pl": "i w nie na się z do to że jest jak o ale za po tak od przez jego był czy",
    "ro": "și în de la cu a nu pe este că din un o care pentru mai se au fi ca",
    "ru": "и в не на что с он как это по но из за то от его было так для бы же",
    "sk": "a je sa na v že s z do o to ako ale sú za pre by bol jeho ktorý aj",
    "sr": "и је у на се да су за од с као што није или али који би то ће бити из",
    "sv": "och i att det är en på som för av med inte den till har de ett om var från jag inte vi kan så efter ut när upp där hade mycket vid än alla också skulle vad gamla",
    "sw": "na ya wa kwa ni katika za la kuwa hiyo cha kama watu pia lakini huo yake",
    "tl": "ang ng sa na mga ay at si ito hindi para kung may niya ako siya lang po",
    "tr": "ve bir bu da de için ile olarak çok daha gibi ne olan ama en değil var kadar",
    "uk": "і в не на що з він як це по але із за то від його було так для та й",
    "vi": "và của là có không được một cho các những trong với đã này người để khi đó",
    "de": "als an war aus bei nach noch nur oder sie wir ihr ich es um am wie aber vor durch wenn einer eines kann über mehr sein",
    "en": "from or an they which one you were all her she there would their we him been has when who will more no if out so",
    "es": "a su como ha pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos ni son fue",
    "fr": "en par ne se son nous vous mais ou si leur y plus sont cette ses aux été comme je elle même ces sans tout fait",
    "it": "si da ma le al ha i su lo se ci quando cosa anche noi loro questo sua suo degli delle nella molto tutto fu",
    "pt": "se ao mas ele ela das seu sua ou quando muito já eu também só pelo pela até isso entre depois sem mesmo aos ter seus nas me esse eles está você tinha foram essa num nem suas meu às minha têm numa pelos elas havia seja qual será nós tenho lhe deles",
}
WORDS = {code: " ".join([*FUNCTION_WORDS.get(code, []), more]) for code, more in MORE_WORDS.items()}

CYRILLIC = ("bg", "ru", "sr", "uk")
#: Letters of other scripts, as ranges of a character class, and the language that a text mostly in them has; the first that fits.
SCRIPTS = [
    ("el", "Ͱ-Ͽἀ-῿"), ("he", "֐-׿"), ("ar", "؀-ۿ"), ("hi", "ऀ-ॿ"), ("bn", "ঀ-৿"), ("th", "฀-๿"),
    ("ka", "Ⴀ-ჿ"), ("hy", "԰-֏"), ("ko", "ᄀ-ᇿ가-힣"), ("ja", "ぁ-ヿ"), ("zh", "一-鿿"),
]
#: Letters by which Persian and Urdu differ from Arabic.
ARABIC = [("ur", "ٹڈڑںے"), ("fa", "پچژگی")]


def profile(text: str) -> dict[str, int]:
    """The weights of a text's trigrams within words, a blank on either side: RANKS for the most frequent, one less for each that is more frequent."""
    n = Counter(f" {w} "[k : k + 3] for w in re.split(r"[\W\d_]+", text.lower()) if w for k in range(len(w)))
    above = {times: sum(other > times for other in n.values()) for times in set(n.values())}
    return {gram: RANKS - above[times] for gram, times in n.items() if above[times] < RANKS}


PROFILES = {code: profile(f"{SEEDS[code]} {WORDS[code]}") for code in sorted(SEEDS)}
LANGUAGES = list(PROFILES)
