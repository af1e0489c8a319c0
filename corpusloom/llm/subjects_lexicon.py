"""Words and phrases of the nine areas in English, German, Spanish and Russian: what the lexicon and place labelling functions look for.

Plain lists, one entry after the other by comma; an entry is matched in lower case between word boundaries, one ending in @de only in a German
sentence, in @en only in any other. THINGS name what an area
deals with, PLACES the setting of a sentence. Other areas and languages are added here, or given to the operator as a parameter.
"""

THINGS = {
    "science": "photon, photons, spectrum, spectra, polymer, polymers, particle, particles, fossil, fossils, wavelength, wavelengths, crystal, crystals, telescope, telescopes, isotope, isotopes, hypothesis, hypotheses, galaxy, galaxies, enzyme, enzymes, tectonic plate, tectonic plates, orbit, orbits, magnetic field, magnetic fields, reagent, reagents, "
    "wellenlänge, wellenlängen, spektren, spektrum, kristall, kristalle, kristallen, enzym, enzyme, enzymen, umlaufbahn, umlaufbahnen, teilchen, galaxie, galaxien, polymer, polymere, polymeren, photonen, magnetfeld, magnetfelder, magnetfeldern, hypothese, hypothesen, isotop, isotope, isotopen, teleskop, teleskope, teleskopen, reagenz, reagenzien, fossilien, kontinentalplatten, "
    "cristal, cristales, galaxia, galaxias, campos magnéticos, campo magnético, enzima, enzimas, fotón, fotones, órbita, órbitas, fósil, fósiles, hipótesis, telescopio, telescopios, longitudes de onda, longitud de onda, reactivo, reactivos, partícula, partículas, isótopo, isótopos, polímero, polímeros, espectro, espectros, placas tectónicas, "
    "фермент, ферменты, орбита, орбиты, фотон, фотоны, полимер, полимеры, частица, частицы, кристалл, кристаллы, длины волн, длина волны, гипотеза, гипотезы, изотоп, изотопы, галактика, галактики, телескоп, телескопы, реактив, реактивы, спектр, спектры, магнитные поля, магнитное поле, окаменелость, окаменелости, тектонические плиты",
    "law": "court hearing, court hearings, liability, liabilities, contract, contracts, witness, witnesses, by-law, by-laws, injunction, injunctions, juror, jurors, patent, patents, appeal, appeals, warrant, warrants, verdict, verdicts, statute, statutes, clause, clauses, legal brief, legal briefs, plaintiff, plaintiffs, defendant, defendants, lawsuit, lawsuits, "
    "klausel, klauseln, gerichtstermin, gerichtstermine, gerichtsterminen, beklagte, beklagten, satzung, satzungen, berufung, berufungen, verfügung, verfügungen, patente, patenten, vertrag, verträge, verträgen, haftbefehl, haftbefehle, haftbefehlen, schriftsatz, schriftsätze, schriftsätzen, haftung, haftungen, zeugen, kläger, klägern, gesetze, gesetzen, urteil, urteile, urteilen, geschworenen, "
    "mandatos judiciales, mandatos, órdenes judiciales, orden judicial, leyes, alegato, alegatos, acusado, acusados, responsabilidad, responsabilidades, apelación, apelaciones, audiencia, audiencias, sentencias, estatuto, estatutos, demandante, demandantes, contrato, contratos, testigo, testigos, cláusula, cláusulas, patente, patentes, jurados, "
    "жалоба, жалобы, иск, иски, свидетельские показания, показания, ордер, ордера, запреты суда, запрет суда, договор, договоры, доверенность, доверенности, патент, патенты, устав, уставы, судебные приговоры, приговор, приговоры, обязательство, обязательства, судебные заседания, законы, апелляция, апелляции, статьи кодекса, присяжные, истцы, ответчики",
    "sport": "sprint, sprints, referee, referees, playoff, playoffs, hurdle, hurdles, penalty kick, penalty kicks, medal, medals, match, matches, marathon time, marathon times, marathon, marathons, dribble, dribbles, relay team, relay teams, halftime score, halftime scores, coach, coaches, league table, league tables, tournament, tournaments, goalkeeper, goalkeepers, racket, rackets, "
    "marathonzeit, marathonzeiten, tore, toren, medaille, medaillen, torhüter, torhütern, turnier, turniere, turnieren, staffel, staffeln, schiedsrichter, schiedsrichtern, spiele, spielen, endspiel, endspiele, endspielen, sprints, trainer, trainern, elfmeter, elfmetern, ligatabelle, ligatabellen, hürde, hürden, halbzeitstand, halbzeitstände, halbzeitständen, schläger, "
    "raqueta, raquetas, goles, relevos, portero, porteros, penalti, penaltis, partido, partidos, medalla, medallas, entrenador, entrenadores, carreras de vallas, carreras, torneo, torneos, maratón, maratones, clasificaciones, marcador, marcadores, árbitro, árbitros, finales de copa, esprints, "
    "турнир, турниры, штрафные удары, тренировка, тренировки, медаль, медали, ворота, турнирные таблицы, гол, голы, эстафета, эстафеты, счета таймов, судейские свистки, матч, матчи, забег, забеги, марафон, марафоны, ракетка, ракетки, финал, финалы, тренеры, вратари",
    "software": "memory leak, memory leaks, build script, build scripts, race condition, race conditions, debugger, debuggers, static analyser, static analysers, thread pool, thread pools, stack trace, stack traces, unit test, unit tests, merge request, merge requests, deadlock, deadlocks, namespace, namespaces, linker error, linker errors, release branch, release branches, refactoring, refactorings, compiler, compilers, code review, code reviews, "
    "debugger, debuggern, compiler, compilern, buildskript, buildskripte, buildskripten, threadpool, threadpools, namensraum, namensräume, namensräumen, mergeanfrage, mergeanfragen, stapelspur, stapelspuren, speicherleck, speicherlecks, releasezweig, releasezweige, releasezweigen, analysewerkzeug, analysewerkzeuge, analysewerkzeugen, verklemmung, verklemmungen, umbauten am quelltext, linkerfehler, linkerfehlern, wettlaufsituation, wettlaufsituationen, modultest, modultests, "
    "guiones de compilación, espacios de nombres, grupos de hilos, refactorización, refactorizaciones, compilador, compiladores, fugas de memoria, ramas de versión, ramas de versiones, errores de enlace, condiciones de carrera, pruebas unitarias, trazas de pila, interbloqueo, interbloqueos, depurador, depuradores, analizador, analizadores, analizadores estáticos, solicitudes de fusión, "
    "утечки памяти, утечка памяти, рефакторинг, рефакторинги, отладчик, отладчики, компилятор, компиляторы, ветки релиза, ветка релиза, пулы потоков, пул потоков, ошибки компоновки, пространства имён, сценарии сборки, гонки данных, стеки вызовов, стек вызовов, анализатор, анализаторы, модульные тесты, взаимные блокировки, запросы на слияние",
    "medicine": "infection, infections, clinical trial, clinical trials, pulse reading, pulse readings, blood sample, blood samples, ward, wards, symptom, symptoms, nurse, nurses, prescription, prescriptions, diagnosis, diagnoses, antibiotic, antibiotics, surgeon, surgeons, fracture, fractures, dosage, dosages, vaccine, vaccines, allergy, allergies, patient, patients, "
    "klinische studien, klinischen studien, klinische studie, pulswert, pulswerte, pulswerten, impfstoff, impfstoffe, impfstoffen, patienten, knochenbruch, knochenbrüche, knochenbrüchen, chirurg, chirurgen, antibiotika, allergie, allergien, symptom, symptome, symptomen, stationen, dosierung, dosierungen, infektion, infektionen, diagnose, diagnosen, blutprobe, blutproben, rezepte vom arzt, rezepten vom arzt, "
    "diagnóstico, diagnósticos, vacuna, vacunas, salas de hospital, sala de hospital, ensayos clínicos, ensayo clínico, alergia, alergias, pulso, pulsos, cirujano, cirujanos, paciente, pacientes, síntoma, síntomas, recetas médicas, muestras de sangre, fractura, fracturas, antibiótico, antibióticos, dosis, infección, infecciones, "
    "перелом, переломы, симптом, симптомы, рецепты врача, рецепт врача, вакцина, вакцины, инфекция, инфекции, анализы крови, анализ крови, пульс, пульсы, палата, палаты, клинические испытания, дозировка, дозировки, операция, операции, диагноз, диагнозы, аллергия, аллергии, антибиотик, антибиотики, истории болезни, история болезни",
    "finance": "interest rate, interest rates, exchange rate, exchange rates, audit, audits, invoice, invoices, shareholder, shareholders, mortgage, mortgages, deposit, deposits, loan, loans, instalment, instalments, bond yield, bond yields, tax bracket, tax brackets, overdraft, overdrafts, dividend, dividends, hedge, hedges, portfolio, portfolios, ledger, ledgers, "
    "kredit, kredite, krediten, dividende, dividenden, zinssatz, zinssätze, zinssätzen, raten, einlage, einlagen, hypothek, hypotheken, anleihe, anleihen, überziehung, überziehungen, wechselkurs, wechselkurse, wechselkursen, steuerklasse, steuerklassen, prüfbericht, prüfberichte, prüfberichten, hauptbuch, hauptbücher, hauptbüchern, aktionär, aktionäre, aktionären, rechnungen, portfolios, depots@de, absicherungen, "
    "tipos de interés, tipo de interés, tipos de cambio, tipo de cambio, préstamo, préstamos, cartera, carteras, factura, facturas, descubierto, descubiertos, accionista, accionistas, auditoría, auditorías, hipoteca, hipotecas, cuota, cuotas, bono, bonos, dividendo, dividendos, depósito, depósitos, impuesto, impuestos, libros contables, coberturas, "
    "процентная ставка, процентные ставки, налог, налоги, фактура, фактуры, портфель, портфели, облигация, облигации, аудит, аудиты, акция, акции, вклад, вклады, дивиденд, дивиденды, курсы валют, курс валют, овердрафт, овердрафты, кредит, кредиты, ипотека, ипотеки, бухгалтерские книги, взнос, взносы, акционеры",
    "cooking": "oven, ovens, herb, herbs, broth, broths, sauce, sauces, whisked egg, whisked eggs, marinade, marinades, simmering pot, simmering pots, baking tray, baking trays, lentil, lentils, spice, spices, pastry, pastries, dumpling, dumplings, recipe, recipes, garnish, garnishes, dough, doughs, roasted onion, roasted onions, "
    "soße, soßen, knödel, knödeln, brühe, brühen, linsen, topf, töpfe, töpfen, kräuter, kräutern, gewürz, gewürze, gewürzen, backofen, backöfen, teig, teige, teigen, eier, eiern, marinade, marinaden, kochrezept, kochrezepte, kochrezepten, torten, röstzwiebeln, backblech, backbleche, backblechen, "
    "recetas de cocina, receta de cocina, horno, hornos, pastel, pasteles, caldo, caldos, masas, bandeja, bandejas, empanada, empanadas, cebolla, cebollas, hierbas, adobo, adobos, olla, ollas, especias, lentejas, huevos batidos, salsa, salsas, "
    "соус, соусы, виды теста, бульон, бульоны, пельмени, крупы, трава, травы, маринад, маринады, специи, кастрюля, кастрюли, пирог, пироги, духовка, духовки, жареные овощи, рецепты блюд, взбитые яйца, противень, противни",
    "transport": "depot, depots@en, lorry, lorries, bicycle lane, bicycle lanes, freight train, freight trains, detour, detours, bus stop, bus stops, locomotive, locomotives, ferry, ferries, timetable, timetables, traffic light, traffic lights, toll road, toll roads, tram, trams, runway, runways, rail junction, rail junctions, commuter, commuters, ticket gate, ticket gates, "
    "haltestelle, haltestellen, fähre, fähren, pendler, pendlern, lastwagen, güterzug, güterzüge, güterzügen, straßenbahn, straßenbahnen, ampel, ampeln, umleitung, umleitungen, mautstraße, mautstraßen, lokomotive, lokomotiven, schranken, weichen, radweg, radwege, radwegen, landebahn, landebahnen, fahrplan, fahrpläne, fahrplänen, "
    "semáforo, semáforos, trenes de carga, tren de carga, peaje, peajes, paradas de autobús, paradas, locomotora, locomotoras, horario, horarios, pistas de aterrizaje, pistas, desvío, desvíos, cruces de vías, cruces, carriles bici, carril bici, camión, camiones, viajeros, tranvía, tranvías, transbordador, transbordadores, torniquete, torniquetes, "
    "светофор, светофоры, железнодорожные узлы, взлётные полосы, турникет, турникеты, товарные поезда, локомотив, локомотивы, грузовик, грузовики, расписание, расписания, маршрут, маршруты, паром, паромы, трамвай, трамваи, объезд, объезды, платные дороги, остановка, остановки, велодорожка, велодорожки",
    "music": "tempo, tempos, harmony, harmonies, guitar string, guitar strings, octave, octaves, rehearsal, rehearsals, keyboard solo, keyboard solos, ballad, ballads, chord, chords, choir, choirs, melody, melodies, concert, concerts, flute, flutes, violin, violins, symphony, symphonies, drum pattern, drum patterns, sheet score, sheet scores, "
    "tempi, oktave, oktaven, gitarrensaite, gitarrensaiten, geige, geigen, ballade, balladen, harmonie, harmonien, trommelmuster, trommelmustern, proben, orchester, orchestern, chor, chöre, chören, sinfonie, sinfonien, melodie, melodien, partitur, partituren, konzert, konzerte, konzerten, akkord, akkorde, akkorden, flöte, flöten, "
    "acorde, acordes, coro, coros, ritmos de tambor, melodía, melodías, violín, violines, sinfonía, sinfonías, flauta, flautas, balada, baladas, partitura, partituras, octava, octavas, concierto, conciertos, cuerdas de guitarra, armonía, armonías, ensayos del coro, tempos, "
    "ритмы барабанов, октава, октавы, мелодия, мелодии, концерт, концерты, темп, темпы, скрипка, скрипки, симфония, симфонии, хор, хоры, репетиция, репетиции, баллада, баллады, гитарные струны, флейта, флейты, партитура, партитуры, гармония, гармонии, аккорд, аккорды",
}
PLACES = {
    "science": "near absolute zero, in zero gravity, under the microscope, as the theory predicts, in the laboratory notebook, im laborbuch, in der schwerelosigkeit, unter dem mikroskop, wie die theorie vorhersagt, nahe dem absoluten nullpunkt, bajo el microscopio, sin gravedad, cero absoluto, como predice la teoría, en el cuaderno de laboratorio, в лабораторном журнале, как предсказывает теория, в невесомости, под микроскопом",
    "law": "before the judge, under oath, as the civil code requires, by order of the tribunal, at the notary's office, vor dem richter, unter eid, wie das gesetzbuch verlangt, auf anordnung des gerichts, beim notar, ante el juez, bajo juramento, como exige el código, por orden del juez, por orden del tribunal, en la notaría, по решению суда, по доверенности, под присягой, перед судьёй, как требует гражданский кодекс",
    "sport": "after the final whistle, in extra time, in front of the home crowd, on the running track, in the changing room, nach dem schlusspfiff, in der verlängerung, vor heimischem publikum, auf der laufbahn, in der kabine, en la prórroga, en la pista de atletismo, ante la afición local, tras el pitido final, в дополнительное время, на беговой дорожке, после финального свистка, на глазах у болельщиков",
    "software": "while profiling the heap, after the last commit, nightly build, behind a feature flag, in production, nach dem letzten commit, im nächtlichen build, hinter einem schalter, im produktivbetrieb, beim profilen, al perfilar el montículo, tras el último commit, en la compilación nocturna, en producción, под флагом функции, после последнего коммита, в ночной сборке, в промышленной среде",
    "medicine": "before surgery, emergency ward, night shift, without a fever, at the clinic, as the physician advised, vor der narkose, in der notaufnahme, im nachtdienst der klinik, ohne fieber, antes de la anestesia, en urgencias, en la guardia de la clínica, durante la guardia, sin fiebre, перед наркозом, без температуры, в приёмном отделении, во время дежурства",
    "finance": "when the stock exchange opens, net of fees, against collateral, balance sheet, at the end of the fiscal year, bei öffnung der börse, abzug der gebühren, in der bilanz, am ende des geschäftsjahres, cuando abre la bolsa, sin comisiones, en el balance, al cierre del ejercicio, при открытии биржи, за вычетом комиссии, на балансе, в конце отчётного года",
    "cooking": "over a low flame, until golden brown, in a buttered pan, with a pinch of salt, after kneading, bei kleiner flamme, bis alles goldbraun ist, in der gebutterten pfanne, mit einer prise salz, a fuego lento, hasta que esté dorado, en una sartén con mantequilla, con una pizca de sal, на медленном огне, до золотистой корочки, на смазанной сковороде, со щепоткой соли, щепоткой соли",
    "transport": "rush hour, on the northbound platform, past the last roundabout, at the border crossing, along the ring road, im berufsverkehr, auf dem nördlichen bahnsteig, am grenzübergang, an der ringstraße, en hora punta, en el andén norte, en el paso fronterizo, en la circunvalación, в час пик, на северной платформе, на пограничном переезде, вдоль кольцевой",
    "music": "at a slow beat, in a minor key, on the concert stage, for the string section, in the second movement, in moll, auf der konzertbühne, in langsamem takt, im zweiten satz, en tono menor, en el escenario, a ritmo lento, en el segundo movimiento, в медленном ритме, в миноре, на концертной сцене, во второй части сонаты",
}
