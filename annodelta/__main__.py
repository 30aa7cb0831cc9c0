from annodelta.cli import main

main()
