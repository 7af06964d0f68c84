"""Words that names of people are judged and matched by."""

from __future__ import annotations

# A name with one of these words is no person's.
BANNED_WORDS = "alumni return request requested postmaster administrator project user workshop subscriber panel committee news lab list recipient unknown pbwiki archive archives customer support subscription info autoresponder vacation admin facebook twitter linkedin pinterest program manager office information guest viagra".split()
# A name that holds one of these is no person's.
BANNED_PARTS = ["undisclosed", "recipient", "me -"]
# Addresses that begin so tell no person's name.
BANNED_ADDRESSES = "info@ rsvp@ message@ events@ alerts@ bounce@ replies@ mail@ action@ programs@ grants@ invitations-noreply@ invitations@ invite@ invite+ office@ news@ host@ do-not-reply noreply- replyto notification notify@ no-reply noreply@ help@ member@ delivery@ email@ messages-noreply@ discuss@ announce@ orders@ contact@ rewards@".split()
# Given names and the variants that stand for them.
VARIANTS = {
    "adrian": "adriaen",
    "alexander": "alec aleksandar aleksander aleksandr aleksandre aleksandrovich alex alexandr alexandre alexandru alyaksandr oleksandr sandy александр",
    "alexandra": "aleksandra",
    "anthony": "tony",
    "beatrice": "beatrix",
    "benjamin": "benny ben",
    "bernard": "barney bernhard bernie",
    "bogdan": "bohdan",
    "bradley": "brad",
    "brian": "bryan",
    "bruce": "brus",
    "casimir": "kazimierz",
    "caspar": "casper",
    "catherine": "caterina catharine cathy ekaterina katarina katharina",
    "charles": "carl carlo carlos charley charlie chas chuck karl",
    "christian": "cristian",
    "christopher": "kit",
    "constantine": "konstantin konstantinos",
    "corey": "cory",
    "cornelius": "cornelis",
    "damien": "damian",
    "daniel": "dan danny",
    "darryl": "daryl",
    "deborah": "debbie",
    "demetrius": "demetrios",
    "edmund": "edmond",
    "edward": "ed eddie edmund eduard edwin ned ted",
    "eleanor": "eleonora leonor",
    "emmanuel": "emanuele",
    "ernest": "ernie ernst",
    "ferdinand": "fernando",
    "frederik": "fredrik",
    "gennady": "gennadi gennadiy",
    "gerald": "gerard",
    "gerard": "gerhard gerry gérard",
    "henry": "henrique",
    "howard": "howie",
    "hussein": "husayn hussain",
    "ignatius": "ignace",
    "irina": "iryna",
    "jacques": "jaques",
    "james": "jamie",
    "jamie": "jaime",
    "jennifer": "jen",
    "joanna": "johanna",
    "johann": "hans",
    "johannes": "joannes johan",
    "john": "johann johannes jon juan",
    "joseph": "giuseppe iosif joe joey josef josé jozef yosef",
    "juan": "joan",
    "judah": "yehuda yehudah",
    "julia": "yulia",
    "julian": "julien",
    "katherine": "catherine kate katharine kathryn kathy katie",
    "khalid": "khaled",
    "konstantin": "constantin",
    "konstantinos": "kostas",
    "kurt": "curt",
    "lama": "gyatso",
    "larry": "lawrence",
    "lawrence": "laurence",
    "louis": "luis",
    "ludovico": "lodovico",
    "ludwig": "ludvig",
    "luis": "luiz luís",
    "mahmud": "mahmood mahmoud",
    "michael": "micheal michel mick mickey mike mikhail",
    "michelle": "michele",
    "mustafa": "mustapha",
    "nathaniel": "nat nate nathanial",
    "nicholas": "nick nicolas nicolaus nikola nikolai nikolaus nikolay",
    "paul": "pavel",
    "peter": "pieter",
    "philip": "filippo",
    "ray": "raymond",
    "raymond": "ramon",
    "ricardo": "riccardo",
    "richard": "dick ricardo richie rick ricky",
    "robert": "bob bobby rob robbie robin",
    "rod": "roderick",
    "sam": "samantha",
    "sophie": "sophia",
    "stephen": "istván stefan stephan stephanus steve steven stjepan",
    "susan": "sue",
    "tatiana": "tatyana",
    "teresa": "theresa",
    "terry": "terence terrence",
    "tim": "timothy",
    "tony": "antonio",
    "tracy": "tracey",
    "victor": "vittorio",
    "walter": "walther",
    "willem": "wim",
    "william": "willem",
    "yuri": "yury",
    "yury": "yuriy",
}
