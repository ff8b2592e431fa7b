from termloom.cli import main

main()
