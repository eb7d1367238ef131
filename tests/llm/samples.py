"""Short prose in five languages."""

SAMPLES = {
    "en": "The heap keeps its smallest key at the root and moves every other key down. When a key is removed, the last one takes its place and sinks until the order holds again. Please explain why this is faster than sorting the whole list each time. How does the tree know which of its children should be compared first? It writes the values to the map and returns. What should I change in this note? You can show that each step costs only a few cycles, because the path is short and the values are near to each other.",
    "de": "Die Halde hält ihren kleinsten Schlüssel an der Wurzel und schiebt alle anderen nach unten. Wenn ein Schlüssel entfernt wird, nimmt der letzte seinen Platz ein und sinkt, bis die Ordnung wieder stimmt. Bitte erkläre, warum das schneller ist, als jedes Mal die ganze Liste zu sortieren. Man kann die Werte nicht ohne den Baum speichern. Schreibe eine Funktion, um die Zeilen zu zählen, und ordne sie danach nach ihrer Größe. Welche Knoten werden zuerst verglichen, und was geschieht mit den übrigen?",
    "es": "El montículo guarda su clave más pequeña en la raíz y mueve las demás hacia abajo. Cuando se quita una clave, la última ocupa su lugar y baja hasta que el orden se cumple otra vez. Explica por qué esto es más rápido que ordenar toda la lista cada vez. No se pueden guardar los valores sin el árbol. Escribe una función para contar las líneas y ordénalas después según su tamaño. ¿Qué nodos se comparan primero y qué pasa con los otros?",
    "fr": "Le tas garde sa plus petite clé à la racine et déplace toutes les autres vers le bas. Quand une clé est retirée, la dernière prend sa place et descend jusqu'à ce que l'ordre soit rétabli. Explique pourquoi c'est plus rapide que de trier toute la liste à chaque fois. On ne peut pas garder les valeurs sans l'arbre. Écris une fonction pour compter les lignes et range-les ensuite selon leur taille. Quels nœuds sont comparés en premier, et que deviennent les autres ?",
    "zh": "堆把最小的键放在根上，其他的键往下移动。删除一个键以后，最后一个键会占据它的位置并下沉，直到顺序恢复。请解释为什么这样比每次排序整个列表更快。没有树就无法保存这些值。写一个函数来统计行数，然后按照大小排序。哪些节点先比较，其余的怎么办？如何写入数据？",
}
