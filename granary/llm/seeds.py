"""Seed passages for the severity model, written from general knowledge of how people offend and of harmless uses of the same
words; none is taken from a table, though their writer had seen some offending passages before. They widen the reviewers' samples, which do not show every way of offending.

A test asserts that no seed shares five words in a row with a text of the test tables.
"""

#: Insults, threats and wishes of harm aimed at a person; no slur need occur.
ABUSIVE = (
    "You are the dumbest person I have ever met and everybody laughs behind your back.",
    "Shut up, you worthless liar, before somebody shuts you up for good.",
    "I know where you live and I am coming to hurt you tonight.",
    "I swear I will kill you if you post one more word.",
    "You had better watch your back, because an accident could happen to you.",
    "Say that again and you will need a doctor, you have been warned.",
    "I hope you get sick and die alone, nobody will come to your funeral.",
    "You should just kill yourself, the world would be better off.",
    "Go jump off a bridge, nobody here cares about you.",
    "You are a disgrace to your family and a waste of oxygen.",
    "Even your own mother wishes you had never been born.",
    "You are uglier than a pig and you smell even worse.",
    "What a stupid fat cow you are, look at yourself in a mirror.",
    "You are too stupid to breathe, go back to kindergarten, clown.",
    "With a face like yours I would never leave the house.",
    "Your brain must be the size of a pea, you useless fool.",
    "Only a brainless creature like you could write such rubbish.",
    "Get out of here, you filthy rat, you do not belong with decent people.",
    "You deserve a slap and a kick, you spineless coward.",
    "I am going to smash your teeth in when I see you.",
    "We will drag you out of your house and make you pay.",
    "You make me sick, drop dead.",
    "Nobody likes you, nobody ever will, you pathetic nobody.",
    "तुम जैसा मूर्ख आदमी मैंने आज तक नहीं देखा, शर्म से डूब मरो।",
    "तू पैदा ही क्यों हुआ, तेरे माँ-बाप को भी तुझ पर शर्म आती होगी।",
    "चुप हो जा वरना तेरी हड्डियाँ तोड़ दूँगा।",
    "मैं तुझे जान से मार दूँगा, देख लेना।",
    "तेरा घर मुझे मालूम है, रात को आकर तुझे सबक सिखाऊँगा।",
    "तेरी टाँगें तोड़कर हाथ में दे दूँगा।",
    "तू धरती पर बोझ है, मर क्यों नहीं जाता।",
    "अपनी शक्ल देखी है कभी, बंदर भी तुझसे सुंदर होता है।",
    "तेरे दिमाग में भूसा भरा है, गधे की औलाद।",
    "तुझ जैसे नीच और घटिया इंसान को कोई पानी भी न पूछे।",
    "तेरी इतनी हिम्मत, अभी आकर तेरा मुँह तोड़ता हूँ।",
    "तू किसी काम का नहीं, सब तुझसे नफ़रत करते हैं।",
    "अगर दोबारा यहाँ आया तो ज़िंदा वापस नहीं जाएगा।",
    "भगवान करे तू सड़-सड़ कर मरे।",
    "tum jaisa bewakoof insaan duniya me doosra nahi hoga, doob maro.",
    "chup ho ja warna teri haddiyan tod dunga.",
    "main tujhe jaan se maar dunga, dekh lena tu.",
    "tera address pata hai mujhe, ghar aakar marunga.",
    "teri shakal dekh ke ulti aati hai, nikal yahan se.",
    "tere maa baap ko bhi tujh pe sharam aati hogi.",
    "tu dharti pe bojh hai, mar kyun nahi jaata.",
    "tere dimag me bhoosa bhara hai, gadhe ki aulad.",
    "sab tujhse nafrat karte hain, koi tera dost nahi banega.",
    "agli baar dikha to zinda nahi bachega.",
    "kutte ki maut marega tu, yaad rakhna.",
    "tere jaise logon ko internet use karne ka haq nahi.",
    "तेरा code देखकर लगता है तू पैदाइशी dumb है, job छोड़ दे loser।",
    "तेरी profile देखकर सब हँसते हैं, तू joke है, offline हो जा।",
    "अगर office में दिखा तो तेरा face तोड़ दूँगा, warning समझ ले।",
    "तेरे जैसे idiot को team में किसने रखा, resign करके मर जा।",
    "तू total waste है, तेरा brain ही dead है।",
    "तुझ्यासारखा मूर्ख माणूस मी आजवर पाहिला नाही, लाज वाटू दे.",
    "गप्प बस नाहीतर तुझे दात पाडीन.",
    "तुला जिवंत सोडणार नाही, लक्षात ठेव.",
    "तू जन्माला का आलास, तुझ्या आईबापांनाही तुझी लाज वाटते.",
    "तुझं तोंड बघून किळस येते, निघ इथून.",
    "तुझ्या घरी येऊन तुला बडवीन.",
    "তোর মতো বোকা মানুষ আমি জীবনে দেখিনি, লজ্জা কর।",
    "চুপ কর, নইলে তোর দাঁত ফেলে দেব।",
    "তোকে খুন করে ফেলব, মনে রাখিস।",
    "তোর মুখ দেখলে ঘেন্না লাগে, বেরিয়ে যা এখান থেকে।",
    "তুই জন্মালি কেন, তোর মা-বাবাও তোকে নিয়ে লজ্জা পায়।",
    "তোর বাড়ি চিনি, রাতে এসে তোকে পেটাব।",
    "నీలాంటి మూర్ఖుడిని నేను ఎప్పుడూ చూడలేదు, సిగ్గుపడు.",
    "నోరు మూసుకో, లేకపోతే నీ పళ్ళు రాలగొడతాను.",
    "నిన్ను చంపేస్తాను, గుర్తుంచుకో.",
    "તારા જેવો મૂર્ખ માણસ મેં કદી જોયો નથી, શરમ કર.",
    "ચૂપ થા, નહીં તો તારા દાંત તોડી નાખીશ.",
    "તને જીવતો નહીં છોડું, યાદ રાખજે.",
    "ਤੇਰੇ ਵਰਗਾ ਮੂਰਖ ਬੰਦਾ ਮੈਂ ਕਦੇ ਨਹੀਂ ਦੇਖਿਆ, ਸ਼ਰਮ ਕਰ।",
    "ਚੁੱਪ ਕਰ, ਨਹੀਂ ਤਾਂ ਤੇਰੇ ਦੰਦ ਤੋੜ ਦਿਆਂਗਾ।",
    "ਤੈਨੂੰ ਜਿਉਂਦਾ ਨਹੀਂ ਛੱਡਾਂਗਾ, ਯਾਦ ਰੱਖੀਂ।",
    "रे मूढ, त्वं पशुः असि, इतः अपसर।",
    "त्वां हनिष्यामि, दुष्ट, मुखं पिधेहि।",
)

#: Groups of people demeaned, denied their rights, or harm to them called for. X stands for the name of any group.
HATEFUL = (
    "X people are not human, they are animals and must be wiped out.",
    "Every X should be thrown out of this country by force.",
    "We should burn down the shops of the X and chase them away.",
    "Do not rent a house to any X, they are dirty and dangerous.",
    "Do not let your daughter marry into the X, their blood is impure.",
    "The X breed like insects and soon they will replace us.",
    "Send all X to camps, they are a plague on our land.",
    "X are born criminals, it is in their nature to cheat and steal.",
    "The only good X is a dead X.",
    "Women are too stupid to vote and belong in the kitchen.",
    "Boycott everything the X sell until they starve.",
    "X children should not sit in the same classroom as ours.",
    "No temple or well should be open to the X, they pollute everything they touch.",
    "History will thank whoever gets rid of the X.",
    "Their kind spreads disease wherever they settle, keep the X away.",
    "X लोग इंसान नहीं, जानवर हैं, इनका सफ़ाया होना चाहिए।",
    "हर X को देश से मारकर भगाओ।",
    "X की दुकानें जला दो, इनको यहाँ रहने का हक़ नहीं।",
    "X को मकान किराए पर मत दो, ये गंदे और चोर होते हैं।",
    "X के बच्चों को हमारे स्कूल में मत बैठने दो।",
    "X का खून ही खराब है, इनसे रिश्ता मत जोड़ो।",
    "X को कुएँ से पानी मत भरने दो, ये सब अपवित्र कर देते हैं।",
    "X का बहिष्कार करो, भूखे मरेंगे तब समझेंगे।",
    "इन X ने हमारा शहर बर्बाद किया, एक-एक को मार डालो।",
    "औरतों की जगह चूल्हे में है, इन्हें वोट देने का हक़ नहीं होना चाहिए।",
    "X log insaan nahi jaanwar hain, inka safaya hona chahiye.",
    "har X ko desh se maar ke bhagao.",
    "X ki dukaan jala do, inko yahan rehne ka haq nahi.",
    "X ko ghar kiraye pe mat dena, sab chor aur gande hain.",
    "X ke bachon ko school se nikalo, khoon hi kharab hai inka.",
    "X ka boycott karo, bhookhe marenge tab samjhenge.",
    "X लोगों को hire मत करो, ये सब criminal और dirty होते हैं।",
    "सारे X को group से ban करके देश से बाहर फेंको, ये virus हैं।",
    "X लोक माणसे नाहीत, जनावरे आहेत, त्यांचा नायनाट करा.",
    "X लोकांची घरे जाळा, त्यांना गावात राहू देऊ नका.",
    "X लोकांना पाणवठ्यावर येऊ देऊ नका, ते सगळे बाटवतात.",
    "X जन्मतःच चोर असतात, त्यांना मारून पळवा.",
    "X মানুষ নয়, পশু, এদের শেষ করে দাও।",
    "X দের ঘর জ্বালিয়ে দাও, গ্রামে থাকতে দিও না।",
    "X দের রক্তই খারাপ, এরা জন্ম থেকেই চোর।",
    "X দের দোকান থেকে কেউ কিছু কিনবে না, না খেয়ে মরুক।",
    "X మనుషులు కాదు, జంతువులు, వాళ్ళను ఊరి నుండి తరిమేయండి.",
    "X લોકો માણસ નથી, જાનવર છે, એમને ગામમાંથી કાઢી મૂકો.",
    "X ਲੋਕ ਬੰਦੇ ਨਹੀਂ, ਜਾਨਵਰ ਹਨ, ਇਹਨਾਂ ਨੂੰ ਪਿੰਡੋਂ ਕੱਢ ਦਿਓ।",
)

#: Sex depicted or solicited explicitly.
SEXUAL = (
    "He pushed her onto the sofa, pulled off her panties and thrust into her as she screamed with pleasure.",
    "She took him in her mouth while he gripped her hair and groaned.",
    "They tore off each other's clothes and fucked on the kitchen floor.",
    "He licked her nipples and spread her legs, and she was wet for him.",
    "Send me naked pictures of your body and I will show you mine.",
    "Hot singles want sex tonight, watch uncensored porn free here.",
    "Horny girls live on webcam, tell them what to do, they get naked for you.",
    "Looking for a hookup, no strings, I want to feel you inside me.",
    "I want to undress you slowly and taste every inch of your skin.",
    "His fingers slipped inside her and she climaxed, panting his name.",
    "What are you wearing under that, take it off and touch yourself for me.",
    "Escorts available all night, full service, message for rates.",
    "उसने उसकी चोली खोली और उसके स्तनों को चूमते हुए उसके भीतर समा गया।",
    "वह नंगा होकर उसके ऊपर चढ़ गया और दोनों चुदाई करने लगे।",
    "अपनी नंगी तस्वीरें भेजो, मैं भी अपनी भेजूँगा।",
    "आज रात अकेली हूँ, मेरे बिस्तर पर आ जाओ, सब कुछ करने दूँगी।",
    "उसकी जाँघों को सहलाते हुए उसने उसे पूरी तरह निर्वस्त्र कर दिया।",
    "usne uske boobs dabaye aur dono nange hoke chudai karne lage.",
    "apni nude pics bhejo, main bhi bhejunga, raat ko maza karenge.",
    "desi bhabhi ka mms dekho, poori raat ki chudai free me.",
    "aaj raat akeli hoon, bed pe aa jao, sab kuch karne dungi.",
    "अपनी nude photo DM करो, रात को video call पर मज़ा करेंगे।",
    "उसने bra खोली और उसके boobs चूसने लगा, दोनों naked थे।",
    "त्याने तिची चोळी काढली आणि तिच्या स्तनांना चुंबत तिच्यात शिरला.",
    "तुझे नग्न फोटो पाठव, रात्री मजा करू.",
    "সে তার ব্লাউজ খুলে স্তনে চুমু খেতে খেতে তার ভেতরে ঢুকে গেল।",
    "তোমার নগ্ন ছবি পাঠাও, রাতে মজা করব।",
    "వాళ్ళిద్దరూ నగ్నంగా మంచం మీద శృంగారం చేస్తూ మూలిగారు.",
    "બંને નગ્ન થઈને પથારીમાં સંભોગ કરતાં સિસકારા ભરવા લાગ્યાં.",
    "ਦੋਵੇਂ ਨੰਗੇ ਹੋ ਕੇ ਬਿਸਤਰੇ ਉੱਤੇ ਸੰਭੋਗ ਕਰਨ ਲੱਗੇ।",
)

#: Harmless uses of such words: teaching, reporting, medicine, technology, animals and food, self-mockery, refusal of hate.
HARMLESS = (
    "The court convicted him of threatening to kill a neighbour.",
    "Police are looking for the man who sent threats to the editor.",
    "Doctors advise screening for cancer of the breast after forty.",
    "The lesson covered sexual reproduction in plants and animals.",
    "Condoms protect against infections that are passed on during sex.",
    "The nurse examined the vagina and the cervix for signs of infection.",
    "The museum shows a naked statue made of marble.",
    "Kill the zombie process and restart the daemon.",
    "The garbage collector frees dead objects, and the master waits for the slave node.",
    "The exterminators removed the rats and cockroaches from the cellar.",
    "A stray dog and a donkey slept next to the pig pen.",
    "I am such an idiot, I left my own keys in the fridge.",
    "I could slap myself for forgetting your birthday.",
    "The film was terrible, the worst story of the year, but the actors were fine.",
    "In his speech he condemned those who call migrants vermin.",
    "The novel describes how a community was insulted and expelled.",
    "A dictionary lists the word bitch as a female dog.",
    "The hit song is called Beat It, and the band killed it on stage.",
    "The chef beats the eggs, cuts the breast of the chicken and burns the sugar.",
    "Helplines are there for people who think of suicide.",
    "You are wrong about the budget, and I disagree with your plan.",
    "You were late again, please come on time tomorrow.",
    "अदालत ने जान से मारने की धमकी देने वाले को सज़ा सुनाई।",
    "डॉक्टर ने स्तन कैंसर की जाँच के बारे में बताया।",
    "जीव विज्ञान के पाठ में प्रजनन और यौन शिक्षा के बारे में पढ़ाया गया।",
    "खेत में कुत्ता, गधा और सूअर घूम रहे थे।",
    "किसी भी समुदाय को जन्म के कारण नीच कहना अपराध है।",
    "कीड़ों और चूहों को भगाने के लिए गोदाम में दवा छिड़की गई।",
    "फ़िल्म बेकार थी, पर गाने अच्छे थे।",
    "teacher ne samjhaya ki kisi ko gadha kehna galat hai.",
    "main bhi kitna pagal hoon, charger ghar bhool gaya.",
    "movie bakwas thi yaar, paise waste ho gaye.",
    "gali me kutta bhaunk raha tha, bachche dar gaye.",
    "process ko kill karke server restart kar do.",
    "doctor ne breast cancer ki jaanch ke baare me bataya.",
    "यह stupid laptop फिर hang हो गया, process kill करना पड़ा।",
    "मैं कितना dumb हूँ, अपना ही password भूल गया।",
    "कोणाला गाढव म्हणणे चुकीचे आहे असे बाईंनी समजावले.",
    "न्यायालयाने धमकी देणाऱ्याला शिक्षा दिली.",
    "गोठ्यात कुत्रा, गाढव आणि डुक्कर झोपले होते.",
    "डॉक्टरांनी स्तनाच्या कर्करोगाची तपासणी केली.",
    "কাউকে গাধা বলা কেন অন্যায় তা শিক্ষক বোঝালেন।",
    "আদালত হুমকি দেওয়ার অপরাধে তাকে সাজা দিল।",
    "উঠোনে কুকুর, গাধা আর শূকর ঘুরছিল।",
    "চিকিৎসক স্তন ক্যানসারের পরীক্ষা করলেন।",
)
