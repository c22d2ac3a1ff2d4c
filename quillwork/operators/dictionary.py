"""A small dictionary of legal phrases by category; a start, to be replaced by a table of one's own.

Each line: category, weight, then phrases of the three languages of the corpus
(en | fr | ar), words in lower case. Phrases of several words weigh more, as
they are rarer by chance. Used through `categorize_by`, which takes any table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LINES = """
banking 3: bank account, credit institution | compte bancaire, établissement de crédit | حساب بنكي
banking 1: bank, loan, deposit | banque, prêt, dépôt | بنك, قرض
civil 3: civil liability, legal capacity | responsabilité civile, capacité juridique | المسؤولية المدنية
civil 1: obligation, contract | obligation, contrat | عقد, التزام
commercial 3: limited liability company, commercial register | société à responsabilité limitée, registre du commerce | السجل التجاري
commercial 1: merchant, bankruptcy | commerçant, faillite | تاجر, إفلاس
consumer 3: consumer protection, right of withdrawal | protection du consommateur, droit de rétractation | حماية المستهلك
consumer 1: consumer, warranty | consommateur, garantie | مستهلك
criminal 3: criminal code, prison sentence | code pénal, peine de prison | القانون الجنائي
criminal 1: offence, prosecution | infraction, poursuite | جريمة, عقوبة
education 3: higher education, school year | enseignement supérieur, année scolaire | التعليم العالي
education 1: school, university | école, université | مدرسة, جامعة
energy 3: renewable energy, power station | énergie renouvelable, centrale électrique | الطاقة المتجددة
energy 1: electricity, gas | électricité, gaz | كهرباء, غاز
environment 3: protected area, waste water | aire protégée, eaux usées | المياه العادمة
environment 1: pollution, waste | pollution, déchets | تلوث, نفايات
family 3: marriage contract, child custody | acte de mariage, garde des enfants | عقد الزواج, حضانة الأطفال
family 1: marriage, divorce, inheritance | mariage, divorce, succession | زواج, طلاق, إرث
health 3: public health, health insurance | santé publique, assurance maladie | الصحة العمومية
health 1: hospital, physician | hôpital, médecin | مستشفى, طبيب
insurance 3: insurance policy, insured event | police d assurance, contrat d assurance | عقد التأمين
insurance 1: insurer, premium | assureur, prime | تأمين
labor 3: employment contract, trade union | contrat de travail, syndicat professionnel | عقد الشغل
labor 1: employee, wage, dismissal | salarié, salaire, licenciement | أجير, أجر
public-procurement 3: call for tenders, public procurement | appel d offres, marchés publics | الصفقات العمومية
public-procurement 1: tender, bidder | soumission, soumissionnaire | طلب عروض
real-estate 3: land register, building permit | conservation foncière, permis de construire | التحفيظ العقاري
real-estate 1: lease, landlord | bail, bailleur | كراء, عقار
tax 3: income tax, value added tax | impôt sur le revenu, taxe sur la valeur ajoutée | الضريبة على الدخل
tax 1: tax, customs | impôt, douane | ضريبة, جمارك
"""
LANGUAGES = ("en", "fr", "ar")


def entries() -> list[tuple[str, str, int, str]]:
    """(phrase, category, weight, language) of every phrase."""
    out = []
    for line in LINES.strip().split("\n"):
        head, _, lists = line.partition(": ")
        category, weight = head.split(" ")
        for language, phrases in zip(LANGUAGES, lists.split(" | ")):
            out += [(p.strip(), category, int(weight), language) for p in phrases.split(",")]
    return out


def bundled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(entries(), "phrase string, category string, weight int, language string")
