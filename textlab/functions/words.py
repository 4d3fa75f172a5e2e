"""Fixed word lists and suffix tables the text operators use by default."""

from __future__ import annotations

# Letters of a word and its vowels.
LETTERS = "a-zA-ZąćęłńóśżźĄĆĘŁŃÓŚŻŹ"
VOWELS = "aeiouyąęó"

# Domain stop words (titles, procedural fillers, page artefacts).
DOMAIN_STOPWORDS = tuple(
    """
    pan pani panie panią posłanka posłanki posłem posła posłowi posłów posłom poseł
    posłowie wysoki wysoka sejm marszałek marszałku rząd rządu klub klubu klubie
    klubowy klubowe klubowej klubowego klubowych sekretarz sekretarza sekretarzem
    sekretarzu przewodniczący przewodnicząca wicemarszałek wicemarszałku marszałkini
    sala salę salą głos głosy oklaski wrzawa porządek porządku druk punkt dziennego
    dziennej dziennym dziennych dzienny izba izbie izbo izbę oświadczenie oświadczenia
    oświadczeń oświadczeniu parlamentarny parlamentarna parlamentarne parlamentarnych
    parlamentarnego parlamentarnym parlamentarnymi interpelacja interpelacje
    interpelacji interpelacjami imieniu imieniem koalicja koalicji koalicję koalicyjny
    koalicyjna koalicyjne ustawa ustawy ustawie ustaw posiedzenie posiedzenia
    posiedzeniu kadencja kadencji dzień dniem dniu sprawie sprawy sprawą spraw proszę
    dziękuję państwo państwa
    pkt ust art nbsp www http https dler
    """.split()
)

# Common Polish function words; callers with their own base list pass it instead.
BASE_STOPWORDS = tuple(
    """
    aby ale ani bardzo bez będzie bo by być był była było były chce choć ci co coś czy
    czyli dla do dlatego gdy gdyż gdzie go ich ile im inne iż ja jak jakie jako jednak
    jego jej jest jeszcze jeśli jeżeli już każdy kiedy kto która które którego której
    który których którym którzy lub ma mają mam mi mnie może można mu my na nad nam nas
    nie nich nic niej niż no od on ona one oni oraz po pod ponieważ przed przez przy są
    się skąd tak taki takie tam te tego tej ten też to tu tych tylko tym u w was we wam
    więc wszystko z za ze że
    """.split()
)

# Endings stripped by the light stemmer, in order of trial.
FOLD_SUFFIXES = tuple(
    """
    skiego ckiego zkiego skiej ckiej zkiej skim ckim zkim ską cką zką ska cka zka ski
    cki zki owa owe owy owej owym ego emu ej ie ich imi ami ach ące ący ąca ejszy
    ejsza
    """.split()
)

# Case endings appended to a name part ("" keeps the bare form).
CASE_SUFFIXES = (
    "",
    *"""
    a u owi em ie ą ę y om ami ach ów owie ego owej owym owa skie skim skiego skiej
    ckie ckim ckiego ckiej
    """.split(),
)

# Adjectival surname endings and the forms that replace them.
SURNAME_FORMS = {
    "ski": ("ski", "ska", "skiego", "skiej", "skim", "scy", "skich"),
    "cki": ("cki", "cka", "ckiego", "ckiej", "ckim", "ccy", "ckich"),
    "ska": ("ski", "skiej", "ską"),
    "cka": ("cki", "ckiej", "cką"),
}

# Frequently mentioned names that no roster lists.
EXTRA_NAMES = tuple(
    """
    tusk kaczyński morawiecki trzaskowski duda kiełbasa bosak mentzen hołownia czarzasty
    zandberg marszałkin marszałek dąbrowska banaszek dąbrowski trzaskowskiego
    górczewska bodnar bodnara rafala rafał pawel paweł
    """.split()
)
