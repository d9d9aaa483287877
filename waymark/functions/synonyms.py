"""What words and abbreviations of addresses stand for: numbers and ordinals by rule, abbreviations as a table."""

from __future__ import annotations

# The numbers of which figures, Roman ones too, are read as words.
NUMBERS = "un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix_sept dix_huit dix_neuf vingt".split()
# Abbreviations in addresses, forms => words.
ABBREVIATIONS = """
ach => ancien chemin
aer => aerodrome
afn => afrique du nord
agl => agglomeration
all,al,alle => allee
ang => angle
anc => ancien
aut => autoroute
av, ave, aven => avenue
bcle => boucle
bd,bld,bou,bould,bvd,boul => boulevard
ber => berge
brg => bourg
brtl => bretelle
bsn => bassin
car => carriere
caref => carrefour
cd => chemin departemental
cdt => commandant
cf => chemin forestier
ch,che,chem => chemin
chev => chevalier
chl => chalet
chp => champ
chps => champs
cha,chs,chse,chss => chaussee
cht => chateau
clef => cle
clefs => cles
clr => couloir
col => colonel
cor,crnc => corniche
cpg => camping
cpt => capitaine
cr => chemin rural
ci,cit => cite
clo => clos
ctr => contour
cou,cr => cour
crx => croix
ctre => centre
cv => chemin vicinal
dept => departement
devi => deviation
dig => digue
dom => domaine
dr,doct => docteur
dra => draille
dre => dreve
dsc => descente
ecl => ecluse
embr => embranchement
enc => enclos
enf,enfts => enfants
entr => entree
espa => espace
espl => esplanade
etng => etang
fac => facade
fg, fbg, fbourg => faubourg
fon,font => fontaine
for => foret
frm => ferme
gale => galerie
gbd => grand boulevard
gde => grande
gdes => grandes
gds => grands
gen,gal,gl => general
gir => giratoire
gpl => grand place
gr => grande rue
grp,grpe => groupe
hab,habit => habitation
ham => hameau
hle => halle
hlg => halage
hlm => habitation a loyer modere
hop,hosp => hopital
ht => haut
hte => haute
htes => hautes
hts => hauts
imp => impasse
ings => ingenieurs
jard,jar => jardin
jte => jetee
lnt,lnant,lieut,lt => lieutenant
lot,lotis,lotiss => lotissement
lyc => lycee
mal, ml => marechal
mais => maison
march => marche
mln => moulin
mme => madame
mgr => monseigneur
mqs => marquis
mqse => marquise
mrn => marina
mt => mont
mte => montee
mtgne => montagne
nd => notre dame
nouv => nouveau
nte => nouvelle route
nve => neuve
pae => petite avenue
pass,pge,psge => passage
pch => petit chemin
pdt => president
periph => peripherique
pkg => parking
pl,pla,plac => place
ple => passerelle
pln => plaine
plt => plateau
pnt => pointe
porq => portique
pr => pere
pref => prefecture
prl => parc residentiel de loisirs
prof => professeur
prom,prm => promenade
pta => petite allee
pte => porte
ptr => petite rue
ptte => placette
pvr,pai,prv => parvis
qrt,qua,quart => quartier
qu, q => quai
r => rue
ran => rangee
rav => ravin
rd => route departementale
rdl => raidillon
regt => regiment
renc => rencontre
rep => republique
res => residence
rfg => refuge
rle,ruel,rul => ruelle
rn => route nationale
rpe => rampe
rpt,rdpoint,rop,rdp,rondpoint,rdpt => rond point
rtd => rotonde
rte,rou => route
ruet => ruette
ruis => ruisseau
rult => ruellette
rve => ravine
sen,sent => sentier
sgt => sergent
sq,squ => square
ss => sous
st => saint
std,stde => stade
ste => sainte
stes => saintes
stg => stage
sts => saints
tpl => terre plein
trab => traboule
trn => terrain
trt => tertre
tsse,ter => terrasse
tun,tunn => tunnel
vall => vallon
valee => vallee
vc => voie communale
vche,vch => vieux chemin
ven => venelle
vge => village
viad => viaduc
vil => ville
vla => villa
vte => vieille route
za => zone artisanale
zac => zone amenagement concerte
zi => zone industrielle
zup => zone urbaniser en priorite
"""


def roman(n: int) -> str:
    out = ""
    for value, letters in ((10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out, n = out + letters * (n // value), n % value
    return out


def ordinal(word: str) -> str:
    """The ordinal of a number word from two up."""
    stem = word.removesuffix("e")
    return {"cinq": "cinqu", "neuf": "neuv"}.get(stem, stem) + "ieme"


def of_numbers() -> dict[str, str]:
    """Figures and Roman numbers of 1 to 20 and 100, and ordinals written as figures or Roman numbers with an ending."""
    out = {"100": "cent", "neufieme": "neuvieme", "1er": "premier", "1e": "premier", "ier": "premier"}
    out |= dict.fromkeys(("1ere", "1re", "iere", "ire"), "premiere")
    for n, word in enumerate(NUMBERS, 1):
        spoken = word.replace("_", " ")
        out |= {str(n): spoken, roman(n): spoken}
        if n > 1:
            out |= dict.fromkeys((f"{x}{end}" for x in (n, roman(n)) for end in ("e", "eme")), ordinal(word).replace("_", " ").replace("dix neufieme", "dix neuvieme"))
    return out


def table() -> dict[str, str]:
    """word -> words, of numbers and abbreviations."""
    from .french import read_synonyms

    return of_numbers() | read_synonyms(ABBREVIATIONS.splitlines())
